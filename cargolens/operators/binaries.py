"""Executable headers inside binary content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens import fixed
from cargolens.functions.binary import latin1, le_uint
from cargolens.functions.text import location_offset
from cargolens.operators.findings import emit
from cargolens.operators.network import with_artifacts

_CPU = "".join(f"\\x{c:02x}" for c in fixed.MACHO_CPU_TYPES)
_COMMANDS = f"\\x01-\\x{fixed.MACHO_MAX_COMMANDS - 1:02x}"
_ARCHES = f"\\x01-\\x{fixed.MACHO_MAX_ARCHES:02x}"
_ANY = r"[\x00-\xff]"

# Where a header can start.  The fixed fields that follow each magic are part of the
# expression, so random bytes rarely match; only PE needs a second look.
_HEADERS = {
    "PE": rf"MZ{_ANY}{{58}}{_ANY}[\x00-\x10]\x00\x00",
    "ELF": r"\x7fELF[\x01\x02][\x01\x02]\x01",
    "FAT": rf"\xca\xfe\xba\xbe\x00\x00\x00[{_ARCHES}]",
    "BIG": rf"\xfe\xed\xfa[\xce\xcf][\x00\x01]\x00\x00[{_CPU}]{_ANY}{{8}}\x00\x00\x00[{_COMMANDS}]",
    "LITTLE": rf"[\xce\xcf]\xfa\xed\xfe[{_CPU}]\x00\x00[\x00\x01]{_ANY}{{8}}[{_COMMANDS}]\x00\x00\x00",
}
# the first byte is tested on its own, which rejects most positions at once
_ANY_HEADER = r"(?s)(?=[M\x7f\xca\xce\xcf\xfe])(?=" + "|".join(_HEADERS.values()) + ")"
_MAGICS = ("MZ", "\x7fELF", "\xca\xfe\xba\xbe\x00", "\xfe\xed\xfa", "\xfa\xed\xfe")


_CHUNK = 1 << 14
_LOOKAHEAD = 0x40  # the longest expression above


def _chunk_offsets(content: Column, chunk: Column) -> Column:
    """0-based offsets inside one chunk at which a header can start.

    The chunk is cut in front of every candidate; the lengths of the pieces add up to the
    offsets.
    """
    text = latin1(F.substring(content, chunk * _CHUNK + 1, F.lit(_CHUNK + _LOOKAHEAD - 1)))
    pieces = F.transform(
        F.array(text),
        lambda t: F.when(
            reduce(Column.__or__, [t.contains(m) for m in _MAGICS]),
            F.split(t, _ANY_HEADER),
        ).otherwise(F.array(t)),
    )[0]
    # The running total of the lengths: the last is the end of the chunk, not a start.
    starts = F.aggregate(
        pieces,
        F.array(F.lit(0)).cast("array<int>"),
        lambda done, p: F.array_append(done, F.element_at(done, -1) + F.length(p)),
        lambda done: F.slice(done, F.lit(1), F.size(done) - 1),
    )
    return F.transform(
        F.filter(starts, lambda o: o < _CHUNK), lambda o: chunk * _CHUNK + o
    )


def _kind_at(content: Column, offset: Column) -> Column:
    start = latin1(F.substring(content, offset + 1, F.lit(24)))
    pe_offset = le_uint(F.substring(content, offset + 0x3C + 1, F.lit(4)), 4)
    pe_mark = F.substring(content, offset + pe_offset.cast("int") + 1, F.lit(4))
    is_pe = pe_offset.between(fixed.PE_OFFSET_MIN, fixed.PE_OFFSET_MAX) & (
        pe_mark == F.lit(bytearray(b"PE\x00\x00"))
    )
    macho = "|".join(_HEADERS[k] for k in ("FAT", "BIG", "LITTLE"))
    return (
        F.when(start.startswith("MZ"), F.when(is_pe, "PE"))
        .when(start.rlike("(?s)^" + _HEADERS["ELF"]), "ELF")
        .when(start.rlike(f"(?s)^(?:{macho})"), "Mach-O")
    )


def find_executables(
    contents: DataFrame,
    max_per_artifact: int | None = None,
    base: Column | None = None,
    owned: Column | None = None,
    length: Column | None = None,
) -> DataFrame:
    """(artifact_id, content) -> embedded headers with offset and remaining size.

    Everything happens inside the task that read the file: the content is searched chunk
    by chunk and only the headers leave the row.  All headers are kept;
    ``max_per_artifact`` keeps the first ones by offset.

    Where a content is a range of a file of ``length`` bytes, it begins at ``base``, and
    headers count that start in its first ``owned`` bytes.
    """
    content = F.col("content")
    n_bytes = F.octet_length(content)
    base = F.lit(0) if base is None else base
    whole = n_bytes if length is None else length
    chunks = F.sequence(F.lit(0), F.floor((n_bytes - 1) / _CHUNK).cast("int"))
    offsets = F.flatten(F.transform(chunks, lambda c: _chunk_offsets(content, c)))
    if owned is not None:
        offsets = F.filter(offsets, lambda o: o < owned)
    headers = F.filter(
        F.transform(
            offsets,
            lambda o: F.struct(
                _kind_at(content, o).alias("signature_type"),
                (base + o).cast("bigint").alias("offset"),
                (whole - base - o).cast("bigint").alias("size"),
            ),
        ),
        lambda h: h["signature_type"].isNotNull(),
    )
    found = (
        contents.filter(n_bytes > 0)
        .select("artifact_id", F.inline_outer(headers))
        .filter(F.col("offset").isNotNull())
    )
    return cap_signatures(found, max_per_artifact) if max_per_artifact else found


def cap_signatures(embedded: DataFrame, n: int = fixed.MAX_SIGNATURES) -> DataFrame:
    """The first n headers of every artifact by offset, one per offset.

    The rank limit is applied before the shuffle as well (window group limit), so a hot
    artifact sends at most n rows per task.
    """
    order = Window.partitionBy("artifact_id").orderBy("offset", "signature_type")
    unique = embedded.dropDuplicates(["artifact_id", "offset"])
    return unique.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n).drop("rn")


def capped_artifacts(embedded: DataFrame, n: int = fixed.MAX_SIGNATURES) -> DataFrame:
    """(artifact_id, n_headers, n_dropped): where ``cap_signatures`` leaves headers out."""
    counts = (
        embedded.select("artifact_id", "offset")
        .distinct()
        .groupBy("artifact_id")
        .agg(F.count(F.lit(1)).alias("n_headers"))
    )
    return counts.filter(F.col("n_headers") > n).withColumn("n_dropped", F.col("n_headers") - n)


def executable_findings(embedded: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """One finding per artifact and offset."""
    rows = with_artifacts(
        embedded.groupBy("artifact_id", "offset").agg(
            F.min("signature_type").alias("signature_type")
        ),
        artifacts,
    )
    return emit(
        rows,
        detector="executable",
        code="MLS-EXE-001",
        severity="critical",
        confidence="high",
        message=F.concat(F.lit("Embedded executable header: "), "signature_type"),
        location=location_offset(F.col("path"), F.col("offset")),
        major=F.col("offset"),
        details={"signature_type": F.col("signature_type"), "offset": F.col("offset")},
    )
