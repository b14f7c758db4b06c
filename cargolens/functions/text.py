"""Paths, locations, references and other text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cargolens import fixed

REFERENCE_FALLBACK = "urn:reference:"


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; '' for none and for names that only start with one."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def is_companion_file(path: Column) -> Column:
    """Files that are analysed with their bundle instead of on their own."""
    return (basename(path) == fixed.BUNDLE_CONFIG) | (extension(path) == ".py")


def is_unsafe_member_name(name: Column) -> Column:
    return (
        (name == "")
        | name.contains("\x00")
        | name.contains("\\")
        | name.startswith("/")
        | name.rlike(r"^\p{L}:")
        | F.array_contains(F.split(name, "/"), "..")
    )


def is_tensor_member(name: Column) -> Column:
    return name.rlike(fixed.TENSOR_MEMBER_PATTERN)


def is_object_dtype(dtype: Column) -> Column:
    clean = F.regexp_replace(dtype, r"^[<>|= ]+", "")
    return clean.rlike(r"^O\d*$") | F.lower(clean).startswith("object")


def has_position_anchor(location: Column) -> Column:
    """The location names a point in the artifact, not only its path."""
    return (
        location.rlike(r"offset\s+\d+")
        | location.rlike(r"(?U)#[^\W\d]\w*(?:\.\w+)+$")
        | location.contains("metadata key:")
    )


def location_call(path: Column, position: Column) -> Column:
    """path:offset n"""
    return F.concat(path, F.lit(":offset "), position.cast("string"))


def location_offset(path: Column, position: Column) -> Column:
    """path (offset n)"""
    return F.concat(path, F.lit(" (offset "), position.cast("string"), F.lit(")"))


def location_symbol(path: Column, module: Column, name: Column) -> Column:
    """path#module.name"""
    return F.concat(path, F.lit("#"), module, F.lit("."), name)


def location_key(path: Column, key: Column) -> Column:
    """path (metadata key: 'k')"""
    return F.concat(path, F.lit(" (metadata key: '"), key, F.lit("')"))


def byte_offset(location: Column) -> Column:
    """n of '(offset n)', null for every other form."""
    digits = F.regexp_extract(location, r"\(offset\s+(\d+)\)", 1)
    return digits.try_cast("bigint")


_NEEDS_QUOTING = r"[^A-Za-z0-9_.~-]"


def uri_path(path: Column) -> Column:
    """Percent-encode every path segment, keep the slashes."""
    quoted = F.array_join(F.transform(F.split(path, "/"), _form_quote), "/")
    return F.when(path.rlike(r"[^A-Za-z0-9_.~/-]"), quoted).otherwise(path)


def _form_quote(text: Column) -> Column:
    """RFC 3986 quoting on top of form encoding ('+' and '*' differ, '~' stays)."""
    quoted = F.url_encode(text)
    quoted = F.replace(quoted, F.lit("+"), F.lit("%20"))
    quoted = F.replace(quoted, F.lit("*"), F.lit("%2A"))
    return F.replace(quoted, F.lit("%7E"), F.lit("~"))


def _url_quote(text: Column) -> Column:
    return F.when(text.rlike(_NEEDS_QUOTING), _form_quote(text)).otherwise(text)


def reference_uri(kind: Column, ref_id: Column) -> Column:
    kind = F.lower(kind)
    number = F.regexp_replace(ref_id, "CWE-|cwe-", "")
    return (
        F.when(kind == "cve", F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), ref_id))
        .when(
            kind == "cwe",
            F.concat(
                F.lit("https://cwe.mitre.org/data/definitions/"), number, F.lit(".html")
            ),
        )
        .when(
            kind == "bdu",
            F.concat(F.lit("https://bdu.fstec.ru/threat/"), _url_quote(ref_id)),
        )
        .otherwise(F.concat(F.lit(REFERENCE_FALLBACK), _url_quote(ref_id)))
    )


def cwe_number(ref_id: Column) -> Column:
    return F.regexp_replace(ref_id, "CWE-|cwe-", "").try_cast("int")


def compliance_tag(standard: str, requirement: Column) -> Column:
    lowered = F.lower(requirement)
    if standard == "owasp_ml":
        return F.concat(F.lit("owasp-ml:"), lowered)
    if standard == "fstec":
        return F.concat(
            F.lit("fstec:"), F.replace(lowered, F.lit("уби."), F.lit("ubi-"))
        )
    return F.concat(F.lit("gost:56939-2024:"), requirement)


def human_size(size: Column) -> Column:
    """A number of bytes, of any integer type, in the largest unit it fills."""

    def scaled(unit: int, label: str) -> Column:
        # One digit, rounded half to even by whole numbers: a double of some millions has too
        # few digits left to tell a half from its neighbours.
        value = size.cast("double") / F.lit(unit)
        whole = F.floor(value)
        rest = ((value - whole) * unit).cast("bigint") * 10
        tenths = F.floor(rest / unit)
        twice = (rest - tenths * unit) * 2
        up = (twice > unit) | ((twice == unit) & (tenths % 2 == 1))
        digits = (whole * 10 + tenths + up.cast("bigint")).cast("decimal(20,0)") / 10
        return F.concat(digits.cast("decimal(21,1)").cast("string"), F.lit(f" {label}"))

    return (
        F.when(size >= fixed.GIB, scaled(fixed.GIB, "GiB"))
        .when(size >= fixed.MIB, scaled(fixed.MIB, "MiB"))
        .when(size >= fixed.KIB, scaled(fixed.KIB, "KiB"))
        .otherwise(F.concat(size.cast("string"), F.lit(" bytes")))
    )


def split_symbol(arg: Column) -> Column:
    """'module name' at the last space; without a space the name is empty."""
    has_space = arg.contains(" ")
    return F.struct(
        F.when(has_space, F.regexp_extract(arg, r"(?s)^(.*) [^ ]*$", 1))
        .otherwise(arg)
        .alias("module"),
        F.when(has_space, F.regexp_extract(arg, r"(?s) ([^ ]*)$", 1))
        .otherwise(F.lit(""))
        .alias("name"),
    )


def dotted_prefixes(name: Column) -> Column:
    """a.b.c -> [a, a.b, a.b.c]."""
    parts = F.split(name, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."),
    )


def iso_timestamp(ts: Column) -> Column:
    """UTC, seconds, trailing Z (the session time zone must be UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def json_version(manifest: Column, key: str = "keras_version") -> Column:
    """A non-empty string field of a JSON manifest, null otherwise."""
    value = F.try_variant_get(F.try_parse_json(manifest), f"$.{key}", "variant")
    text = F.try_variant_get(value, "$", "string")
    is_text = F.schema_of_variant(value) == "STRING"
    return F.when(is_text & (text != ""), text)


def localized(locale: str, translated: Column, default: Column) -> Column:
    """The translated text when the locale asks for it and it is there.

    Texts come in the language of the rules and in English; another locale is refused.
    """
    if locale not in fixed.LOCALES:
        raise ValueError(f"no texts for locale {locale!r}, only for {', '.join(fixed.LOCALES)}")
    if locale != "en":
        return default
    return F.coalesce(F.when(translated != "", translated), default)
