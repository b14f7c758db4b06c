"""Bundles: Python files next to a configuration that may load them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens import fixed
from cargolens.functions.text import dotted_prefixes
from cargolens.operators.findings import emit


def target_file(target: Column) -> Column:
    """The file a reference loads; null for remote and unusable references."""
    module = F.when(
        target.endswith(".py"), F.regexp_replace(target, r"\.py$", "")
    ).when(
        target.contains("."), F.regexp_extract(target, r"^(.*)\.[^.]*$", 1)
    ).otherwise(target)
    file = F.concat(F.replace(module, F.lit("."), F.lit("/")), F.lit(".py"))
    return F.when((target != "") & ~target.contains("--") & (module != ""), file)


def target_class(target: Column) -> Column:
    """The class a reference names, null when it names a file."""
    usable = ~target.contains("--") & ~target.endswith(".py") & target.rlike(r"[^.].*\.[^.]+$")
    return F.when(usable, F.regexp_extract(target, r"\.([^.]+)$", 1))


def resolve_bundle_refs(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Files of every bundle with a ``referenced`` flag."""
    loaded = (
        refs.select("bundle_id", target_file(F.col("target")).alias("py_file"))
        .filter("py_file is not null")
        .distinct()
        .withColumn("referenced", F.lit(True))
    )
    return files.join(loaded, ["bundle_id", "py_file"], "left").withColumn(
        "referenced", F.coalesce("referenced", F.lit(False))
    )


def loaded_classes(refs: DataFrame) -> DataFrame:
    """(bundle_id, py_file, class_name): classes whose special methods run on load."""
    return (
        refs.select(
            "bundle_id",
            target_file(F.col("target")).alias("py_file"),
            target_class(F.col("target")).alias("class_name"),
        )
        .filter("py_file is not null and class_name is not null")
        .distinct()
    )


def oversized_sources(files: DataFrame) -> DataFrame:
    """Files too large for static analysis."""
    return files.filter(F.col("size") > fixed.PY_MAX_BYTES).select(
        "bundle_id", "py_file", F.lit("source file too large").alias("error")
    )


def name_matches(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """The first hit of every (file, pattern, position).

    A name matches a target that equals it or one of its dotted prefixes: the prefixes are
    exploded and joined on equality, so the join hashes.  ``seq`` is the order of the names
    in the file.
    """
    hits = names.select(
        "bundle_id",
        "py_file",
        "name",
        "line",
        "pos",
        "seq",
        F.explode(dotted_prefixes(F.col("name"))).alias("target"),
    ).join(patterns, "target")
    return (
        hits.groupBy("bundle_id", "py_file", "id", "pos", "class")
        .agg(F.min(F.struct("seq", "line", "name")).alias("first"))
        .select(
            "bundle_id", "py_file", F.col("id").alias("pattern_id"), "pos", "class", "first.*"
        )
    )


def bundle_findings(
    files: DataFrame,
    names: DataFrame,
    obfuscations: DataFrame,
    patterns: DataFrame,
    refs: DataFrame,
) -> DataFrame:
    """Findings per file: the reference itself, risky calls by place and class, and
    obfuscation; files nobody refers to get one note.

    Everything known of a file becomes one row, and the row its findings: each table is read
    once, and all joins have the keys of the file.  ``name_matches`` leaves one hit per pattern
    and position, so a row is bounded by the rule pack.
    """
    file = ["bundle_id", "py_file"]
    place = F.when(
        F.col("pos") == "load",
        F.when(F.col("class") == "side-effect", "load-side").otherwise("load-exec"),
    ).otherwise("method")
    shown = F.concat(
        "pattern_id", F.lit(" ("), "name", F.lit(":"), F.col("line").cast("string"), F.lit(")")
    )
    hits = (
        name_matches(names, patterns)
        .withColumns({"place": place, "shown": shown})
        .groupBy(*file)
        .agg(
            F.array_sort(
                F.collect_list(F.struct("pattern_id", "pos", "line", "class", "shown", "place"))
            ).alias("all_hits")
        )
    )
    hidden = obfuscations.groupBy(*file).agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("kinds"),
    )
    rows = (
        resolve_bundle_refs(refs, files)
        .select(*file, "referenced")
        .join(hits, file, "left")
        .join(hidden, file, "left")
    )
    used = F.col("referenced")

    def entry(code: Column | str, minor: int, own: Column | None = None) -> Column:
        none = F.array().cast(hits.schema["all_hits"].dataType)
        code = F.lit(code) if isinstance(code, str) else code
        return F.struct(
            code.alias("code"), F.lit(minor).alias("minor"), (none if own is None else own).alias("hits")
        )

    def calls(name: str, minor: int) -> Column:
        own = F.filter("all_hits", lambda h: h["place"] == name)
        return F.when(used & (F.size(own) > 0), entry("MLS-BUNDLE-002", minor, own))

    entries = F.array_compact(
        F.array(
            entry(F.when(used, "MLS-BUNDLE-001").otherwise("MLS-BUNDLE-003"), 0),
            calls("load-exec", 1),
            calls("load-side", 2),
            calls("method", 3),
            F.when(used & F.col("kinds").isNotNull(), entry("MLS-BUNDLE-004", 4)),
        )
    )
    found = rows.select(
        *file,
        "referenced",
        "kinds",
        "n",
        F.col("bundle_id").alias("artifact_id"),
        F.concat("bundle_id", F.lit("/"), "py_file").alias("path"),
        F.inline(entries),
    )
    code, minor = F.col("code"), F.col("minor")
    is_call, is_hidden = code == "MLS-BUNDLE-002", code == "MLS-BUNDLE-004"
    listed = F.array_join(F.transform("hits", lambda h: h["shown"]), ", ")
    first_line = F.try_element_at(
        F.filter(
            F.transform("hits", lambda h: h["line"]),
            lambda n: n.isNotNull() & (n != 0),
        ),
        F.lit(1),
    )
    return emit(
        found,
        detector="bundle_code",
        code=code,
        codes=[f"MLS-BUNDLE-00{i}" for i in range(1, 5)],
        severity=F.when(minor == 1, "high").when(minor == 2, "low").otherwise("info"),
        confidence=F.when(is_call, "medium")
        .when(code == "MLS-BUNDLE-001", "high")
        .otherwise("low"),
        message=F.when(is_call, F.concat("py_file", F.lit(" calls "), listed))
        .when(is_hidden, F.concat("py_file", F.lit(" hides names: "), "kinds"))
        .when(used, F.concat(F.lit("Loaded with the model: "), "py_file"))
        .otherwise(F.concat(F.lit("Not loaded by the configuration: "), "py_file")),
        location=F.when(
            first_line.isNotNull(), F.concat("path", F.lit(":"), first_line.cast("string"))
        ).otherwise(F.col("path")),
        minor=minor,
        label=F.col("py_file"),
        details={
            "py_file": F.col("py_file"),
            "referenced": F.when(minor == 0, used),
            "position": F.when(is_call, F.when(minor == 3, "method").otherwise("load")),
            "class": F.when(is_call, F.col("hits")[0]["class"]),
            "patterns": F.when(is_call, listed),
            "kinds": F.when(is_hidden, F.col("kinds")),
            "n": F.when(is_hidden, F.col("n")),
        },
    )
