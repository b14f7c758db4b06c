"""Callables an artifact names: framework vote, allowlists, blocklist, patterns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens import fixed
from cargolens.functions.text import location_call, location_symbol
from cargolens.operators.findings import emit, union_findings
from cargolens.session import computed, rule_table

ANY_FRAMEWORK = "*"

Indicators = Mapping[str, Sequence[str]]


def _text(*names: str) -> pa.Schema:
    return pa.schema([(n, pa.string()) for n in names])


# --- names --------------------------------------------------------------------------------


def canonical_module(module: Column) -> Column:
    """Old module names under their present name; the callable name never changes."""
    names = F.create_map(*[F.lit(x) for pair in fixed.MODULE_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, module), module)


def _in_pairs(module: Column, name: Column, pairs: tuple) -> Column:
    """Set membership of a pair, as one hashed lookup."""
    return F.concat(module, F.lit(" "), name).isin(*[f"{m} {n}" for m, n in pairs])


def is_dangerous(module: Column, name: Column) -> Column:
    """The pair, under its present module name, is on the fixed blocklist."""
    return _in_pairs(canonical_module(module), name, fixed.DANGEROUS_CALLABLES)


# --- framework vote ---------------------------------------------------------------------


_MASK_BITS = 62


def indicator_table(spark: SparkSession, indicators: Indicators) -> DataFrame:
    """(framework, module) rows."""
    rows = [{"framework": f, "module": m} for f, modules in indicators.items() for m in modules]
    return rule_table(spark, rows, _text("framework", "module"))


def indicator_matches(
    globals_: DataFrame, indicators: Indicators = fixed.FRAMEWORK_INDICATORS
) -> DataFrame:
    """Indicator modules of every artifact, one row per (artifact, framework, module)."""
    table = indicator_table(globals_.sparkSession, indicators)
    return (
        globals_.select("artifact_id", "module")
        .join(table, "module")
        .select("artifact_id", "framework", "module")
        .distinct()
    )


def framework_vote(
    globals_: DataFrame, indicators: Indicators = fixed.FRAMEWORK_INDICATORS
) -> DataFrame:
    """The framework with the most indicator modules; ties go by the order of the table,
    and one scikit-learn module beats a numpy majority.  Artifacts without a match are
    'unknown'.

    Each indicator is one bit.  An artifact's modules collapse to a few numbers with
    ``bit_or``, which combines before the shuffle, needs no distinct and keeps a fixed-size
    state however many callables an artifact has.
    """
    slots = [
        (framework, part, modules[part : part + _MASK_BITS])
        for framework, modules in indicators.items()
        for part in range(0, len(modules), _MASK_BITS)
    ]
    bits: dict[str, dict[str, int]] = {}
    for i, (_, _, modules) in enumerate(slots):
        for bit, module in enumerate(modules):
            bits.setdefault(module, {})[f"m{i}"] = 1 << bit
    names = [f"m{i}" for i in range(len(slots))]
    schema = pa.schema([("module", pa.string()), *[(n, pa.int64()) for n in names]])
    table = rule_table(
        globals_.sparkSession,
        [{"module": m, **dict.fromkeys(names, 0), **masks} for m, masks in bits.items()],
        schema,
    )
    masks = (
        globals_.select("artifact_id", "module")
        .join(table, "module", "left")
        .groupBy("artifact_id")
        .agg(*[F.coalesce(F.bit_or(n), F.lit(0)).alias(n) for n in names])
    )

    def mine(framework: str) -> list[tuple[str, Sequence[str]]]:
        return [(n, ms) for n, (f, _, ms) in zip(names, slots, strict=True) if f == framework]

    def tally(priority: int, framework: str) -> Column:
        n = sum((F.bit_count(m) for m, _ in mine(framework)), F.lit(0))
        return F.struct(
            n.alias("n"),
            F.lit(-priority).alias("rank"),
            F.lit(framework).alias("framework"),
            (n / F.lit(float(len(indicators[framework])))).alias("share"),
        )

    def matched(framework: str) -> Column:
        flags = [
            F.when(F.col(m).bitwiseAND(1 << bit) != 0, F.lit(module))
            for m, modules in mine(framework)
            for bit, module in enumerate(modules)
        ]
        return F.array_sort(F.filter(F.array(*flags), lambda x: x.isNotNull()))

    tallies = {f: tally(i, f) for i, f in enumerate(indicators)}
    decided = computed(masks, best=F.array_max(F.array(*tallies.values())))
    winner = F.col("best")
    if "numpy" in tallies and "sklearn" in tallies:
        sklearn = tallies["sklearn"]
        winner = F.when(
            (F.col("best.framework") == "numpy") & (sklearn["n"] > 0), sklearn
        ).otherwise(winner)
    decided = computed(decided, w=winner)
    known = F.col("w.n") > 0
    # only the list of the winner is built
    modules = F.when(~known, F.array().cast("array<string>"))
    for framework in indicators:
        modules = modules.when(F.col("w.framework") == framework, matched(framework))
    return decided.select(
        "artifact_id",
        F.when(known, F.col("w.framework")).otherwise("unknown").alias("framework"),
        F.when(known, F.bround(F.least(F.col("w.share"), F.lit(1.0)), 4))
        .otherwise(0.0)
        .alias("confidence"),
        modules.alias("detected_patterns"),
    )


# --- allowlist -----------------------------------------------------------------------------


def _scopes(pack: DataFrame) -> DataFrame:
    """(framework, source): which packs a framework reads.

    transformers also reads pytorch and numpy; every other known framework reads its own;
    the unknown framework '*' reads all of them.
    """
    own = pack.select(F.col("framework").alias("source")).distinct()
    readers = (
        F.when(
            F.col("source").isin("pytorch", "numpy"),
            F.array(F.col("source"), F.lit("transformers"), F.lit(ANY_FRAMEWORK)),
        )
        .otherwise(F.array(F.col("source"), F.lit(ANY_FRAMEWORK)))
    )
    return own.select("source", F.explode(readers).alias("scope")).distinct()


def scope_pack(pack: DataFrame) -> DataFrame:
    """The pack keyed by ``scope`` instead of ``framework``."""
    return (
        pack.withColumnRenamed("framework", "source")
        .join(_scopes(pack), "source")
        .drop("source")
        .distinct()
    )


def with_scope(globals_: DataFrame, contexts: DataFrame, pack: DataFrame) -> DataFrame:
    """Callables with their framework and the scope they are looked up in."""
    known = (
        pack.select(F.lower("framework").alias("scope"))
        .union(pack.sparkSession.range(1).select(F.lit("transformers")))
        .distinct()
    )
    framed = globals_.select("artifact_id", "module", "name").distinct().join(
        contexts.select("artifact_id", "framework"), "artifact_id", "left"
    ).withColumn("framework", F.coalesce("framework", F.lit("unknown")))
    lowered = framed.withColumn("wanted", F.lower("framework"))
    return (
        lowered.join(known, lowered["wanted"] == known["scope"], "left")
        .withColumn("scope", F.coalesce("scope", F.lit(ANY_FRAMEWORK)))
        .select("artifact_id", "module", "name", "framework", "scope")
    )


def not_allowed(
    globals_: DataFrame, contexts: DataFrame, allowlist: DataFrame
) -> DataFrame:
    """Callables whose raw pair is not listed for their framework."""
    scoped = with_scope(globals_, contexts, allowlist)
    return scoped.join(scope_pack(allowlist), ["scope", "module", "name"], "left_anti")


def with_trust(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Mark rows whose module starts with a trusted prefix of their scope.

    The prefixes of a scope travel as one array, so the rows join on the scope alone and
    no row meets every prefix.
    """
    lists = scope_pack(prefixes).groupBy("scope").agg(
        F.array_sort(F.collect_set("prefix")).alias("prefixes")
    )
    module = F.col("module")
    return (
        rows.join(lists, "scope", "left")
        .withColumn(
            "trusted",
            F.coalesce(
                F.exists("prefixes", lambda p: module.startswith(p)), F.lit(False)
            ),
        )
        .drop("prefixes")
    )


def allowlist_findings(
    globals_: DataFrame,
    contexts: DataFrame,
    allowlist: DataFrame,
    prefixes: DataFrame,
    artifacts: DataFrame | None = None,
) -> DataFrame:
    """Callables outside the allowlist; blocklisted pairs are left to the blocklist."""
    module, name = F.col("module"), F.col("name")
    rows = with_trust(
        not_allowed(globals_, contexts, allowlist).filter(~is_dangerous(module, name)),
        prefixes,
    )
    severity = (
        F.when(F.col("trusted") & name.isin(*fixed.DANGEROUS_NAMES), "high")
        .when(F.col("trusted"), "info")
        .otherwise("medium")
    )
    code = F.when(severity == "info", "MLS-ALW-002").otherwise("MLS-ALW-001")
    return emit(
        with_path(rows, artifacts),
        detector="allowlist",
        code=code,
        codes=("MLS-ALW-001", "MLS-ALW-002"),
        severity=severity,
        confidence="low",
        message=F.concat(
            module, F.lit("."), name, F.lit(" is not on the allowlist of "), "framework"
        ),
        location=location_symbol(F.col("path"), module, name),
        label=F.concat(module, F.lit("\x01"), name),
        details={"module": module, "name": name, "framework": F.col("framework")},
    )


def with_path(rows: DataFrame, artifacts: DataFrame | None) -> DataFrame:
    """Add ``path``, also for failed artifacts."""
    if artifacts is None:
        return rows.withColumn("path", F.col("artifact_id"))
    return rows.join(artifacts.select("artifact_id", "path"), "artifact_id")


# --- literal getattr calls -----------------------------------------------------------------


def dangerous_attributes() -> tuple[str, ...]:
    names = {n for _, n in fixed.DANGEROUS_CALLABLES} | set(fixed.DANGEROUS_ATTRIBUTES_EXTRA)
    return tuple(sorted(names))


def getattr_literals(metadata: DataFrame) -> DataFrame:
    """(artifact_id, attribute): literal attribute names, members merged with their artifact."""
    return (
        metadata.filter(F.col("key") == "getattr_literal_attrs")
        .select("artifact_id", F.explode(F.split("value", ",")).alias("attribute"))
        .filter(F.col("attribute") != "")
        .distinct()
    )


def getattr_facts(metadata: DataFrame) -> DataFrame:
    """Flags and literal counts per artifact, as plain aggregates of any size.

    One read: a row is a flag or a literal name, and the names count once they are distinct.
    """
    keys = ("getattr_present", "getattr_dynamic", "getattr_literal_attrs")
    key, value = F.col("key"), F.col("value")
    literals = F.filter(F.split(value, ","), lambda a: a != "")
    # names without an artifact count for none
    named = (key == keys[2]) & F.col("artifact_id").isNotNull()
    once = (
        metadata.filter(key.isin(*keys))
        .select(
            "artifact_id",
            ((key == keys[0]) & (value == "true")).alias("present"),
            ((key == keys[1]) & (value == "true")).alias("dynamic"),
            F.explode_outer(F.when(named, literals)).alias("attribute"),
        )
        .groupBy("artifact_id", "attribute")
        .agg(F.bool_or("present").alias("present"), F.bool_or("dynamic").alias("dynamic"))
    )
    return once.groupBy("artifact_id").agg(
        F.bool_or("present").alias("present"),
        F.bool_or("dynamic").alias("dynamic"),
        F.count("attribute").alias("n_literals"),
        F.count_if(F.col("attribute").isin(*dangerous_attributes())).alias("n_dangerous"),
    )


def safe_getattr_artifacts(metadata: DataFrame) -> DataFrame:
    """Artifacts that read attributes only by harmless literal names."""
    return (
        getattr_facts(metadata)
        .filter(~F.col("dynamic") & (F.col("n_literals") > 0) & (F.col("n_dangerous") == 0))
        .select("artifact_id")
    )


# --- blocklist -------------------------------------------------------------------------------


def first_calls(reduce_calls: DataFrame) -> DataFrame:
    """(artifact_id, module, name, position) of the first call of every callable."""
    return reduce_calls.groupBy("artifact_id", "module", "name").agg(
        F.min("position").alias("position")
    )


_ANY_NON_ASCII = r"[^\x00-\x7F]"


def suspicious_globals(globals_: DataFrame) -> DataFrame:
    """(artifact_id, module, name, code): distinct callables that earn a finding.

    One pass; everything harmless is dropped before the shuffle of ``distinct``.
    """
    module, name = F.col("module"), F.col("name")
    persistent = module == "__persid__"
    codes = F.filter(
        F.array(
            F.when(~persistent & is_dangerous(module, name), "MLS-PKL-001"),
            F.when(module.rlike(_ANY_NON_ASCII) | name.rlike(_ANY_NON_ASCII), "MLS-PKL-002"),
            F.when(persistent, "MLS-PKL-003"),
        ),
        lambda c: c.isNotNull(),
    )
    return (
        globals_.select("artifact_id", "module", "name", F.explode_outer(codes).alias("code"))
        .filter(F.col("code").isNotNull())
        .distinct()
    )


def blocked_globals(globals_: DataFrame, metadata: DataFrame) -> DataFrame:
    """``suspicious_globals`` without getattr where only harmless literals are read."""
    rows = suspicious_globals(globals_).withColumn(
        "canonical", canonical_module(F.col("module"))
    )
    harmless = safe_getattr_artifacts(metadata).withColumn("harmless", F.lit(True))
    is_getattr = (
        (F.col("code") == "MLS-PKL-001")
        & (F.col("canonical") == "builtins")
        & (F.col("name") == "getattr")
    )
    return (
        rows.join(harmless, "artifact_id", "left")
        .filter(~(is_getattr & F.coalesce("harmless", F.lit(False))))
        .drop("harmless")
    )


def callable_findings(
    globals_: DataFrame,
    reduce_calls: DataFrame,
    metadata: DataFrame,
    artifacts: DataFrame | None = None,
) -> DataFrame:
    """Blocklisted, look-alike and persistent callables."""
    module, name, code = F.col("module"), F.col("name"), F.col("code")
    calls = first_calls(reduce_calls.filter(is_dangerous(module, name)))
    rows = with_path(
        blocked_globals(globals_, metadata).join(
            calls, ["artifact_id", "module", "name"], "left"
        ),
        artifacts,
    )
    blocked = code == "MLS-PKL-001"
    mild = _in_pairs(F.col("canonical"), name, fixed.DANGEROUS_CALLABLE_HIGH)
    alias = F.when(
        blocked & (F.col("canonical") != module),
        F.concat(F.lit(" (old name of "), "canonical", F.lit("."), name, F.lit(")")),
    ).otherwise("")
    kind = (
        F.when(blocked, "Forbidden callable ")
        .when(code == "MLS-PKL-002", "Look-alike callable ")
        .otherwise("Persistent reference ")
    )
    return emit(
        rows,
        detector="blocklist",
        code=code,
        codes=("MLS-PKL-001", "MLS-PKL-002", "MLS-PKL-003"),
        severity=F.when(blocked & ~mild, "critical").otherwise("high"),
        confidence=F.when(blocked, "certain").otherwise("high"),
        message=F.concat(kind, module, F.lit("."), name, alias),
        location=F.when(
            blocked & F.col("position").isNotNull(),
            location_call(F.col("path"), F.col("position")),
        ).otherwise(F.col("path")),
        major=F.when(code == "MLS-PKL-002", 0).otherwise(1),
        label=F.concat(module, F.lit("\x01"), name),
        details={
            "module": F.when(blocked, module),
            "name": F.when(blocked, name),
            "module_repr": F.when(code == "MLS-PKL-002", module),
            "name_repr": F.when(code == "MLS-PKL-002", name),
            "persid_value": F.when(code == "MLS-PKL-003", name),
        },
    )


def blocklist_findings(
    globals_: DataFrame,
    reduce_calls: DataFrame,
    metadata: DataFrame,
    artifacts: DataFrame | None = None,
) -> DataFrame:
    return union_findings(
        callable_findings(globals_, reduce_calls, metadata, artifacts),
        flag_findings(metadata, artifacts),
    )


def flag_findings(metadata: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """Facts a reader left in the metadata."""
    key, value = F.col("key"), F.col("value")
    code = (
        F.when((key == "parse_stop_attack") & (value != ""), "MLS-PKL-004")
        .when((key == "embedded_strings") & (value != ""), "MLS-PKL-005")
        .when((key == "opcode_limit_exceeded") & (value == "true"), "MLS-PKL-006")
    )
    known = metadata.filter(key.isin("parse_stop_attack", "embedded_strings", "opcode_limit_exceeded"))
    rows = known.withColumn("code", code).filter("code is not null")
    c = F.col("code")
    shown = F.array_join(F.slice(F.split("value", r",\s*"), 1, 5), ", ")
    return emit(
        with_path(rows, artifacts),
        detector="blocklist",
        code=c,
        codes=("MLS-PKL-004", "MLS-PKL-005", "MLS-PKL-006"),
        severity=F.when(c == "MLS-PKL-006", "medium").otherwise("high"),
        confidence=F.when(c == "MLS-PKL-004", "high").otherwise("medium"),
        message=F.when(c == "MLS-PKL-004", F.lit("The stream stops and goes on later"))
        .when(c == "MLS-PKL-005", F.concat(F.lit("Embedded source: "), shown))
        .otherwise(F.lit("Unusually long stream, analysis cut short")),
        location=F.col("path"),
        label=c,
        details={"patterns": F.when(c == "MLS-PKL-005", value)},
    )


# --- vulnerability patterns ---------------------------------------------------------------------


def _exploded_patterns(patterns: DataFrame) -> DataFrame:
    return patterns.select(
        "id", F.posexplode("affected_globals").alias("rule_pos", "ref")
    ).select("id", "rule_pos", "ref.module", "ref.name")


def trigger_hits(opcodes: DataFrame, patterns: DataFrame) -> DataFrame:
    """(artifact_id, id) where an opcode of the artifact triggers the pattern.

    Opcodes are reduced to the few names the patterns know before anything is shuffled.
    """
    triggers = patterns.select("id", F.explode("trigger_opcodes").alias("opcode")).distinct()
    return (
        opcodes.select("artifact_id", "opcode")
        .join(triggers.select("opcode").distinct(), "opcode", "left_semi")
        .distinct()
        .join(triggers, "opcode")
        .select("artifact_id", "id")
        .distinct()
    )


_PAIR, _CALL, _OPCODE, _FRAMEWORK, _HARMLESS = range(5)


def _pattern_signals(
    opcodes: DataFrame,
    globals_: DataFrame,
    contexts: DataFrame,
    reduce_calls: DataFrame,
    metadata: DataFrame,
    patterns: DataFrame,
) -> DataFrame:
    """(artifact_id, pairs, calls, opcodes, framework, harmless) of artifacts with a listed pair.

    What the patterns know of each fact table is united, and its few distinct rows go to their
    artifact as they are.  Repeats combine before any shuffle; the places a pair has in the
    patterns are added after the last one.
    """
    listed = _exploded_patterns(patterns).groupBy("module", "name").agg(
        F.collect_set(F.struct("id", "rule_pos")).alias("refs")
    )
    names = _exploded_patterns(patterns).select("module", "name").distinct()
    triggers = patterns.select(F.explode("trigger_opcodes").alias("name")).distinct()
    none = F.lit(None)

    def signal(rows: DataFrame, kind: int, **columns: Column) -> DataFrame:
        return rows.select(
            "artifact_id",
            F.lit(kind).alias("kind"),
            *[
                columns.get(name, none).cast(type_).alias(name)
                for name, type_ in (
                    ("module", "string"),
                    ("name", "string"),
                    ("position", "bigint"),
                )
            ],
        )

    pair = {"module": F.col("module"), "name": F.col("name")}
    keys = ("artifact_id", "kind", "module", "name")
    position = F.min("position").alias("position")
    pairs = globals_.select("artifact_id", "module", "name").distinct()
    calls = reduce_calls.join(names, ["module", "name"], "left_semi")
    known = opcodes.select("artifact_id", F.col("opcode").alias("name"))
    repeated = (
        signal(calls, _CALL, position=F.col("position"), **pair),
        signal(known.join(triggers, "name", "left_semi"), _OPCODE, name=F.col("name")),
    )
    signals = (
        reduce(DataFrame.unionByName, repeated).groupBy(*keys).agg(position),
        signal(pairs.join(names, ["module", "name"], "left_semi"), _PAIR, **pair),
        signal(contexts, _FRAMEWORK, name=F.col("framework")),
        signal(safe_getattr_artifacts(metadata), _HARMLESS),
    )
    once = (
        reduce(lambda a, b: a.unionByName(b), [s.select(*keys, "position") for s in signals])
        .repartition("artifact_id")
        .join(listed, ["module", "name"], "left")
    )
    kind = F.col("kind")
    return (
        once.groupBy("artifact_id")
        .agg(
            F.collect_list(F.when(kind == _PAIR, F.struct("module", "name", "refs"))).alias("pairs"),
            F.collect_list(F.when(kind == _CALL, F.struct("module", "name", "position"))).alias(
                "calls"
            ),
            F.collect_list(F.when(kind == _OPCODE, F.col("name"))).alias("opcodes"),
            F.max(F.when(kind == _FRAMEWORK, F.col("name"))).alias("framework"),
            F.bool_or(kind == _HARMLESS).alias("harmless"),
        )
        .filter(F.size("pairs") > 0)
    )


def pattern_matches(
    opcodes: DataFrame,
    globals_: DataFrame,
    contexts: DataFrame,
    reduce_calls: DataFrame,
    metadata: DataFrame,
    patterns: DataFrame,
) -> DataFrame:
    """One row per (artifact, pattern) that meets all conditions of the pattern.

    Every fact table is read once; pairs, triggers and context are tested on the one row that
    an artifact has after the aggregate.
    """
    facts = _pattern_signals(opcodes, globals_, contexts, reduce_calls, metadata, patterns)
    listed = F.flatten(
        F.transform(
            "pairs",
            lambda p: F.transform(
                p["refs"],
                lambda r: F.struct(
                    r["id"].alias("id"),
                    r["rule_pos"].alias("rule_pos"),
                    p["module"].alias("module"),
                    p["name"].alias("name"),
                ),
            ),
        )
    )
    rows = (
        facts.withColumn("listed", listed)
        .withColumn("id", F.explode(F.array_distinct(F.transform("listed", lambda p: p["id"]))))
        .withColumn("pairs", F.array_sort(F.filter("listed", lambda p: p["id"] == F.col("id"))))
        .withColumn(
            "position",
            F.array_min(
                F.transform(
                    F.filter(
                        "calls",
                        lambda c: F.exists(
                            "pairs",
                            lambda p: (p["module"] == c["module"]) & (p["name"] == c["name"]),
                        ),
                    ),
                    lambda c: c["position"],
                )
            ),
        )
    )
    only_getattr = (
        (F.size("pairs") == 1)
        & (F.col("pairs")[0]["module"] == "builtins")
        & (F.col("pairs")[0]["name"] == "getattr")
    )
    rules = patterns.select(
        "id", "severity", "confidence", "references", "context_frameworks", "trigger_opcodes"
    )
    framework = F.lower(F.coalesce("framework", F.lit("unknown")))
    anywhere = F.coalesce(F.size("context_frameworks"), F.lit(0)) <= 0
    untriggered = F.coalesce(F.size("trigger_opcodes"), F.lit(0)) <= 0
    return (
        rows.join(rules, "id")
        .filter(untriggered | F.arrays_overlap("trigger_opcodes", "opcodes"))
        .filter(anywhere | F.array_contains("context_frameworks", framework))
        .filter(~(only_getattr & F.col("harmless")))
        .select(
            "artifact_id",
            "id",
            "severity",
            "confidence",
            "references",
            F.coalesce("framework", F.lit("unknown")).alias("framework"),
            F.array_join(
                F.transform("pairs", lambda p: F.concat(p["module"], F.lit("."), p["name"])),
                ", ",
            ).alias("matched"),
            "position",
        )
    )


def pattern_findings(
    opcodes: DataFrame,
    globals_: DataFrame,
    contexts: DataFrame,
    reduce_calls: DataFrame,
    metadata: DataFrame,
    patterns: DataFrame,
    artifacts: DataFrame | None = None,
) -> DataFrame:
    rows = with_path(
        pattern_matches(opcodes, globals_, contexts, reduce_calls, metadata, patterns),
        artifacts,
    )
    return emit(
        rows,
        detector="cve",
        code=F.concat(F.lit("MLS-"), "id"),
        severity=F.col("severity"),
        confidence=F.col("confidence"),
        message=F.concat(F.lit("Pattern "), "id", F.lit(": "), "matched"),
        location=F.when(
            F.col("position").isNotNull(), location_call(F.col("path"), F.col("position"))
        ).otherwise(F.col("path")),
        label=F.col("id"),
        details={
            "cve_id": F.col("id"),
            "matched_globals": F.col("matched"),
            "framework": F.col("framework"),
        },
        references=F.col("references"),
    )
