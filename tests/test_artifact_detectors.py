"""Callables, archives, formats, bundles and format metadata."""

import json
import pickletools
import random
import struct

import pytest
from pyspark.sql import functions as F

from cargolens import fixed, schema
from cargolens.functions.text import is_unsafe_member_name
from cargolens.operators import (
    binaries,
    bundle,
    callables,
    formats,
    keras,
    kv,
    members,
    metadata,
    registry,
    trees,
)
from cargolens.sources.policy import Policy

ARTIFACT = "artifact_id string, path string, length bigint, scanner string, error string"


# --- callables ----------------------------------------------------------------------------


@pytest.mark.parametrize("modules, framework, confidence", [
    (["torch", "torch.nn", "torch._utils", "numpy"], "pytorch", round(3 / 17, 4)),
    (["numpy", "numpy.core", "numpy.random", "sklearn"], "sklearn",
     round(1 / len(fixed.FRAMEWORK_INDICATORS["sklearn"]), 4)),
    (["torch", "transformers"], "transformers", round(1 / 30, 4)),
    (["torch", "sklearn"], "pytorch", round(1 / 17, 4)),
    (["numpy", "tensorflow"], "tensorflow", round(1 / 11, 4)),
    (["torchvision"], "unknown", 0.0),
])
def test_framework_vote(table, modules, framework, confidence):
    df = table([("a", m, n) for m in modules for n in ("f", "g")], schema.GLOBALS)
    (row,) = callables.framework_vote(df).collect()
    assert (row["framework"], row["confidence"]) == (framework, pytest.approx(confidence))
    if framework != "unknown":
        assert row["detected_patterns"] == sorted(
            set(modules) & set(fixed.FRAMEWORK_INDICATORS[framework]))


def test_vote_with_more_indicators_than_one_mask_holds(table):
    own = {"x": tuple(f"x{i}" for i in range(150)), "y": ("y0",)}
    df = table([("a", f"x{i}", "f") for i in range(0, 150, 3)] + [("b", "y0", "f")], schema.GLOBALS)
    rows = {r["artifact_id"]: r for r in callables.framework_vote(df, own).collect()}
    assert rows["a"]["framework"] == "x" and len(rows["a"]["detected_patterns"]) == 50
    assert rows["b"]["framework"] == "y" and rows["b"]["confidence"] == 1.0


@pytest.fixture(scope="module")
def allow(table):
    pack = table([("pytorch", "torch", "Tensor"), ("numpy", "numpy", "dtype")],
                 "framework string, module string, name string")
    prefixes = table([("pytorch", "torch."), ("numpy", "numpy.")], "framework string, prefix string")

    def run(framework, *pairs):
        globals_ = table([("a", m, n) for m, n in pairs], schema.GLOBALS)
        contexts = table([("a", framework)], "artifact_id string, framework string")
        rows = callables.allowlist_findings(globals_, contexts, pack, prefixes).collect()
        return sorted((r["code"], r["severity"], r["location"]) for r in rows)

    return run


def test_allowlist_levels(allow):
    assert allow("pytorch", ("torch", "Tensor"), ("torch.x", "Y"), ("torch.x", "system"),
                 ("evil", "f"), ("os", "system"), ("__builtin__", "eval")) == [
        ("MLS-ALW-001", "high", "a#torch.x.system"),
        ("MLS-ALW-001", "medium", "a#evil.f"),
        ("MLS-ALW-002", "info", "a#torch.x.Y"),
    ]


def test_allowlist_scopes(allow):
    assert allow("pytorch", ("numpy", "dtype"))[0][1] == "medium"
    assert allow("transformers", ("numpy", "dtype"), ("torch", "Tensor")) == []
    assert allow("whatever", ("numpy", "dtype"), ("torch", "Tensor")) == []


@pytest.mark.parametrize("meta, severity", [
    ([], "high"),
    ([("getattr_literal_attrs", "forward,weight")], None),
    ([("getattr_literal_attrs", "forward,system")], "high"),
    ([("getattr_literal_attrs", "forward"), ("getattr_dynamic", "true")], "high"),
    ([("getattr_literal_attrs", ",")], "high"),
])
def test_literal_getattr(table, meta, severity):
    globals_ = table([("a", "__builtin__", "getattr")], schema.GLOBALS)
    calls = table([("a", "__builtin__", "getattr", 9), ("a", "__builtin__", "getattr", 4)],
                  schema.REDUCE_CALLS)
    facts = table([("a", k, v) for k, v in meta], schema.METADATA)
    rows = callables.callable_findings(globals_, calls, facts).collect()
    assert [(r["severity"], r["location"]) for r in rows] == (
        [(severity, "a:offset 4")] if severity else [])


def test_pattern_needs_trigger_framework_and_a_listed_callable(spark, table):
    patterns = table(
        [("P-1", "high", "high", [("x", "f"), ("y", "g")], ["REDUCE"], ["pytorch"], [])],
        "id string, severity string, confidence string, "
        "affected_globals array<struct<module:string,name:string>>, "
        "trigger_opcodes array<string>, context_frameworks array<string>, "
        "references array<struct<type:string,id:string>>")
    globals_ = table([(a, m, n) for a in "abcd" for m, n in (("y", "g"), ("x", "f"))]
                     + [("e", "z", "f")], schema.GLOBALS)
    opcodes = table([("a", 1, "REDUCE", None), ("b", 1, "MARK", None), ("c", 1, "REDUCE", None),
                     ("e", 1, "REDUCE", None)], schema.OPCODES)
    contexts = table([("a", "PyTorch"), ("b", "pytorch"), ("c", "numpy"), ("e", "pytorch")],
                     "artifact_id string, framework string")
    calls = table([("a", "y", "g", 30), ("a", "x", "f", 50)], schema.REDUCE_CALLS)
    rows = callables.pattern_findings(
        opcodes, globals_, contexts, calls, table([], schema.METADATA), patterns).collect()
    assert [(r["code"], r["location"], r["details"]["matched_globals"]) for r in rows] == [
        ("MLS-P-1", "a:offset 30", "x.f, y.g")]


def test_places_of_a_pair_are_not_moved_with_its_callables(spark, table):
    """Before, every row carried them through two shuffles and was sorted to be distinct."""
    patterns = table(
        [("P-1", "high", "high", [("x", "f"), ("y", "g")], ["REDUCE"], [], []),
         ("P-2", "low", "low", [("y", "g"), ("y", "g")], [], [], [])],
        "id string, severity string, confidence string, "
        "affected_globals array<struct<module:string,name:string>>, "
        "trigger_opcodes array<string>, context_frameworks array<string>, "
        "references array<struct<type:string,id:string>>")
    globals_ = table([("a", "y", "g")] * 3 + [("a", "x", "f"), ("b", "x", "f"), ("b", "x", None),
                      ("c", None, "g")], schema.GLOBALS)
    opcodes = table([("a", i, "REDUCE", None) for i in range(5)] + [("c", 1, "REDUCE", None)],
                    schema.OPCODES)
    calls = table([("a", "y", "g", 40), ("a", "y", "g", 30), ("a", "x", "f", 50), ("d", "x", "f", 1)],
                  schema.REDUCE_CALLS)
    contexts = table([("a", "pytorch"), ("b", "numpy")], "artifact_id string, framework string")
    matches = callables.pattern_matches(
        opcodes, globals_, contexts, calls, table([], schema.METADATA), patterns)
    plan = str(matches._jdf.queryExecution().executedPlan())
    assert "max(refs" not in plan and "SortAggregate" not in plan
    assert plan.index("partial_collect_list") < plan.index("REPARTITION_BY_COL")
    assert sorted((r.artifact_id, r.id, r.matched, r.position) for r in matches.collect()) == [
        ("a", "P-1", "x.f, y.g", 30), ("a", "P-2", "y.g, y.g", 30)]


# --- archives -------------------------------------------------------------------------------


def _archive(table, members_):
    return table([("a", f"m{i}", p, i, f"n{i}", s, "pickle", t, d)
                  for i, (p, s, t, d) in enumerate(members_)], schema.MEMBERS)


@pytest.mark.parametrize("length, unpacked, n, expected", [
    (500 * 1024, 2 * fixed.GIB, 1, [("MLS-CMP-001", "high")]),
    (100 * 1024, 2 * fixed.GIB, 1, [("MLS-CMP-001", "critical")]),
    (5 * fixed.MIB, fixed.GIB, 1, []),
    (1500 * 1024, 2000 * fixed.MIB, 1, [("MLS-CMP-002", "high")]),
    (10 * fixed.MIB, 1001, 1001, [("MLS-CMP-003", "high")]),
    (10 * fixed.MIB, 101, 101, [("MLS-CMP-003", "medium")]),
    (10 * fixed.MIB, 100, 100, []),
])
def test_bombs(table, length, unpacked, n, expected):
    rows = _archive(table, [(None, unpacked // n, None, 1)] * n)
    artifacts = table([("a", "p", length, "pytorch", None)], ARTIFACT)
    found = members.compression_findings(artifacts, rows).collect()
    assert sorted((r["code"], r["severity"]) for r in found) == expected


def test_failed_archive_gives_nothing(table):
    rows = _archive(table, [(None, 2 * fixed.GIB, None, 1)])
    artifacts = table([("a", "p", 1000, "pytorch", "broken")], ARTIFACT)
    assert members.compression_findings(artifacts, rows).count() == 0


def test_deep_tree_with_explicit_totals_against_a_loop(table):
    rng = random.Random(3)
    nodes = []
    for i in range(400):
        parent = rng.choice([None, *range(i)]) if i else None
        depth = 1 if parent is None else nodes[parent][3] + 1
        if depth > 10:
            parent, depth = None, 1
        nodes.append((None if parent is None else f"m{parent}", rng.randrange(100),
                      rng.choice([None, None, None, rng.randrange(1000)]), depth))

    def total(i):
        _, size, explicit, _ = nodes[i]
        below = explicit if explicit is not None else sum(
            total(j) for j, n in enumerate(nodes) if n[0] == f"m{i}")
        return size + below

    expected = sum(total(i) for i, n in enumerate(nodes) if n[0] is None)
    row = members.member_totals(_archive(table, nodes)).first()
    assert (row["n_members"], row["unpacked"]) == (400, expected)


def _chain(table, depth, explicit_at=()):
    return _archive(table, [
        (None if i == 0 else f"m{i - 1}", 1, 7 if i in explicit_at else None, i + 1)
        for i in range(depth)
    ])


def test_a_chain_of_a_thousand_members(table):
    seen = members.visible_members(_chain(table, 1000, {300, 640})).collect()
    assert {int(r["member_id"][1:]) for r in seen if r["hidden"]} == set(range(301, 1000))
    row = members.member_totals(_chain(table, 1000, {300, 640})).first()
    assert (row["n_members"], row["unpacked"]) == (1000, 301 + 7)
    row = members.member_totals(_chain(table, 1000)).first()
    assert (row["n_members"], row["unpacked"]) == (1000, 1000)


def test_broken_trees_end(table):
    nodes = table(
        [("a", m, p, x) for m, p, x in (
            ("top", None, True), ("u", "v", False), ("v", "u", False), ("w", "w", False),
            ("lost", "gone", False), ("low", "lost", False), ("in", "top", False),
            ("in", "top", False), ("under", "in", False), ("round", "u", False),
        )] + [("b", "x", None, False), ("b", "y", "x", False)],
        "artifact_id string, member_id string, parent_id string, marked boolean",
    )
    got = sorted(r["member_id"] for r in trees.below_marked(nodes).collect())
    assert got == ["in", "in", "under"]
    got = sorted(r["member_id"] for r in trees.below_marked(nodes, dangling=True).collect())
    assert got == ["in", "in", "lost", "low", "under"]


def test_running_size_and_budget_across_buckets(table, monkeypatch):
    monkeypatch.setattr(members, "_BUCKET", 8)
    rng = random.Random(5)
    sizes = [rng.randrange(60) * fixed.MIB for _ in range(200)]
    rows = _archive(table, [(None, s, None, 1) for s in sizes])
    running = {r["member_idx"]: r["running"] for r in members.running_size(rows).collect()}
    total, stop = 0, None
    for i, s in enumerate(sizes):
        total += s
        assert running[i] == total
        if stop is None and total > fixed.EXTRACT_TOTAL_BYTES:
            stop = i
    out = {r["member_idx"]: r for r in members.extraction_budget(rows).collect()}
    assert [i for i, r in out.items() if r["reason"]] == [stop]
    assert all(out[i]["extracted"] is (i < stop) for i in out)


@pytest.mark.parametrize("name, unsafe", [
    ("", True), ("a\x00b", True), ("a\\b", True), ("/a", True), ("C:x", True), ("a/../b", True),
    ("my..bak", False), ("a/b", False), ("1:x", False),
])
def test_unsafe_names(table, name, unsafe):
    row = table([(name,)], "n string").select(is_unsafe_member_name(F.col("n")).alias("x")).first()
    assert row["x"] is unsafe


# --- formats --------------------------------------------------------------------------------


def test_disguised_formats(table):
    artifacts = table(
        [("1", "a.safetensors", ".safetensors", "safetensors", "pickle"),
         ("2", "a.pkl", ".pkl", "pickle", "safetensors"),
         ("3", "a.pkl", ".pkl", "pickle", "unknown"),
         ("4", "a.bin", ".bin", "pytorch", "gguf"),
         ("5", "a.npy", ".npy", "numpy", "numpy_npy")],
        "artifact_id string, path string, ext string, scanner string, detected_format string")
    flags = table([("5", "object_dtype_detected", "true")], schema.METADATA)
    rows = {r["artifact_id"]: r for r in formats.format_facts(artifacts, flags).collect()}
    assert {k: r["mismatch"] for k, r in rows.items()} == {
        "1": True, "2": True, "3": False, "4": False, "5": False}
    assert {k: r["safety"] for k, r in rows.items()} == {
        "1": "code_bearing", "2": "code_bearing", "3": "code_bearing", "4": "code_bearing",
        "5": "code_bearing"}
    facts = formats.format_facts(artifacts, table([], schema.METADATA))
    assert facts.filter("artifact_id = '5'").first()["safety"] == "safe"
    assert formats.format_findings(facts).count() == 0


def test_stream_opening_agrees_with_the_standard_library(table):
    rng = random.Random(11)
    heads = [bytes([rng.randrange(256) for _ in range(rng.randrange(1, 40))]) for _ in range(1500)]
    heads += [bytes([ord(op.code)]) + b"12\n34\n" for op in pickletools.opcodes]

    def opens(head):
        try:
            next(pickletools.genops(head))
            return True
        except Exception:
            return False

    df = table([(bytearray(h),) for h in heads], "content binary")
    rows = df.select("content", formats.opens_stream(F.col("content")).alias("x")).collect()
    wrong = [bytes(r["content"]) for r in rows if r["x"] != opens(bytes(r["content"]))]
    # the encoding of text arguments is not checked
    assert [w for w in wrong if chr(w[0]) not in "FVPSX\x8c\x8d"] == []


def _pe(offset=0x80, mark=b"PE\0\0"):
    return b"MZ" + b"\0" * 58 + struct.pack("<I", offset) + b"\0" * (offset - 64) + mark


@pytest.mark.parametrize("blob, kind", [
    (_pe(), "PE"), (_pe(mark=b"PX\0\0"), None), (_pe(0x1000), "PE"), (_pe(0x1100), None),
    (b"\x7fELF\x01\x02\x01", "ELF"), (b"\x7fELF\x03\x02\x01", None),
    (b"\xca\xfe\xba\xbe" + struct.pack(">I", 16), "Mach-O"),
    (b"\xca\xfe\xba\xbe" + struct.pack(">I", 17), None),
    (b"\xcf\xfa\xed\xfe" + struct.pack("<iiII", 0x01000007, 3, 2, 255), "Mach-O"),
    (b"\xcf\xfa\xed\xfe" + struct.pack("<iiII", 0x01000007, 3, 2, 256), None),
    (b"\xfe\xed\xfa\xce" + struct.pack(">iiII", 12, 3, 2, 5), "Mach-O"),
    (b"\xfe\xed\xfa\xce" + struct.pack(">iiII", 13, 3, 2, 5), None),
])
@pytest.mark.parametrize("lead", [0, 1, 16383, 16384, 40000])
def test_executables_at_any_offset(table, blob, kind, lead):
    filler = bytes((i * 37) % 251 | 1 for i in range(lead))
    df = table([("a", bytearray(filler + blob))], "artifact_id string, content binary")
    rows = binaries.find_executables(df).collect()
    assert [(r["signature_type"], r["offset"], r["size"]) for r in rows] == (
        [(kind, lead, len(blob))] if kind else [])


def test_signature_cap_keeps_the_first_by_offset(table):
    df = table([("a", "ELF", i * 3, 1) for i in range(400)] + [("a", "PE", 0, 1)], schema.EMBEDDED)
    rows = binaries.cap_signatures(df).collect()
    assert len(rows) == 256 and max(r["offset"] for r in rows) == 255 * 3


# --- bundles and metadata -------------------------------------------------------------------


def test_bundle_levels(table):
    files = table([("b", "m.py", 1), ("b", "lonely.py", 1)], "bundle_id string, py_file string, size bigint")
    refs = table([("b", "auto_map.AutoModel", "m.Model"), ("b", "x", "hub--m.Model")],
                 "bundle_id string, field string, target string")
    names = table(
        [("b", "m.py", "os.path.join", 1, "load", 1), ("b", "m.py", "os.system", 7, "load", 2),
         ("b", "m.py", "subprocess.run", 9, "load", 3), ("b", "m.py", "socket.socket", 3, "load", 4),
         ("b", "m.py", "eval", 20, "method", 5), ("b", "lonely.py", "exec", 1, "load", 1)],
        "bundle_id string, py_file string, name string, line int, pos string, seq bigint")
    obf = table([("b", "m.py", 4, "base64")], "bundle_id string, py_file string, line int, kind string")
    patterns = table([("os-system", "os.system", "code-exec"), ("subprocess", "subprocess", "code-exec"),
                      ("socket", "socket", "side-effect"), ("eval", "eval", "code-exec"),
                      ("exec", "exec", "code-exec")], "id string, target string, class string")
    rows = bundle.bundle_findings(files, names, obf, patterns, refs).orderBy("ordinal").collect()
    assert [(r["code"], r["severity"], r["location"]) for r in rows] == [
        ("MLS-BUNDLE-003", "info", "b/lonely.py"),
        ("MLS-BUNDLE-001", "info", "b/m.py"),
        ("MLS-BUNDLE-002", "high", "b/m.py:7"),
        ("MLS-BUNDLE-002", "low", "b/m.py:3"),
        ("MLS-BUNDLE-002", "info", "b/m.py:20"),
        ("MLS-BUNDLE-004", "info", "b/m.py"),
    ]


def test_key_words_stand_alone(table):
    artifacts = table([("a", "p", 1, "gguf", None)], ARTIFACT)
    facts = table([("a", "clip.has_vision_encoder", "1"), ("a", "x.exec-y", "1"),
                   ("a", "_code", "1"), ("a", "version", "1.2.3.4"), ("a", "host", "1.2.3.4"),
                   ("a", "gguf_version", "9"), ("a", "gguf_header_valid", "false")], schema.METADATA)
    rows = kv.kv_findings(facts, artifacts).orderBy("ordinal").collect()
    assert [(r["code"], r["details"].get("key")) for r in rows] == [
        ("MLS-GGUF-006", None), ("MLS-GGUF-005", None), ("MLS-GGUF-003", "host"),
        ("MLS-GGUF-001", "x.exec-y")]


def test_numpy_members_need_numpy_all_the_way_up(table):
    artifacts = table([("a", "p.npz", 1, "numpy", None), ("b", "q.pkl", 1, "pickle", None)], ARTIFACT)
    rows = table(
        [("a", "a1", None, 1, "x.npy", 1, "numpy", None, 1),
         ("a", "a2", None, 2, "y.zip", 1, "pickle", None, 1),
         ("a", "a3", "a2", 3, "z.npy", 1, "numpy", None, 2),
         ("a", "a4", "a1", 4, "w.npy", 1, "numpy", None, 2),
         ("b", "b1", None, 1, "v.npy", 1, "numpy", None, 1)], schema.MEMBERS)
    facts = table([(o, "object_dtype_detected", "true") for o in ("a", "a1", "a3", "a4", "b1")],
                  schema.METADATA)
    found = metadata.numpy_findings(artifacts, facts, rows).collect()
    assert sorted(r["path"] for r in found) == ["p.npz", "p.npz/w.npy", "p.npz/x.npy"]


def test_numpy_members_at_depth_twelve(table):
    artifacts = table([("a", "p.npz", 1, "numpy", None)], ARTIFACT)
    rows = table(
        [("a", f"m{i}", f"m{i - 1}" if i > 1 else None, i, f"{i}.npz", 1, "numpy", None, i)
         for i in range(1, 13)], schema.MEMBERS)
    facts = table([("m12", "object_dtype_detected", "true")], schema.METADATA)
    assert [r["path"] for r in metadata.numpy_findings(artifacts, facts, rows).collect()] == [
        "p.npz/12.npz"]


def test_long_first_instruction_routes_like_a_short_one(table):
    rows = [(bytearray(b"B" + struct.pack("<I", n) + b"x" * n + b"."),) for n in (100, 8000)]
    df = table(rows, "content binary")
    found = df.select(formats.opens_stream(F.col("content")).alias("x")).collect()
    assert [r["x"] for r in found] == [True, True]


def test_config_walk_order_depth_and_broken_json(table):
    deep = {"class_name": "Lambda", "config": {"name": "deep"}}
    for _ in range(60):
        deep = {"x": [deep]}
    config = {"layers": [
        {"class_name": "Lambda", "config": {"name": "second", "function": "f()"}},
        {"class_name": "Lambda", "config": {"name": ""}, "registered_name": "C>1"},
        {"class_name": "function", "config": "g()", "registered_name": "function"}], "deep": deep}
    deeper = "[" * 900 + '{"class_name": "Lambda"}' + "]" * 900
    too_deep = "[" * 10**6 + "]" * 10**6
    df = table([("a", json.dumps(config)), ("b", "{oops"), ("c", "[1]"), ("d", too_deep), ("e", deeper)],
               "artifact_id string, config string")
    rows = {(r["artifact_id"], r["key"]): r["value"] for r in keras.keras_facts(df).collect()}
    assert rows[("a", "lambda_layers")] == "second, Lambda, deep"
    assert rows[("a", "custom_objects")] == "C>1"
    assert rows[("c", "lambda_layer_count")] == "0" and rows[("e", "lambda_layer_count")] == "1"
    payloads = keras.payload_strings(keras.config_facts(df)).orderBy("str_idx").collect()
    assert [r["value"] for r in payloads] == ["f()", "g()"]
    errors = {r["artifact_id"]: r["error"] for r in keras.config_errors(df).collect()}
    assert sorted(errors) == ["b", "d"] and errors["d"].endswith("RecursionError")


def test_a_scan_reads_configurations_once_and_keeps_their_errors(spark, table):
    artifacts = table(
        [(x, f"{x}.keras", ".keras", "keras", None, False) for x in ("a", "b")],
        "artifact_id string, path string, ext string, scanner string, error string, unsupported boolean")
    config = {"layers": [{"class_name": "Lambda", "config": {"name": "l", "function": "see http://x.test/y"}}]}
    configs = table([("a", json.dumps(config)), ("b", "{oops")], "artifact_id string, config string")
    facts = registry.with_configs({"artifacts": artifacts, "configs": configs})
    errors = {r["artifact_id"]: r["error"] for r in facts["artifacts"].collect()}
    assert errors == {"a": None, "b": "unreadable configuration: JSONDecodeError"}
    empty = {"globals": schema.GLOBALS, "reduce_calls": schema.REDUCE_CALLS,
             "embedded": "artifact_id string, signature_type string, offset bigint, size bigint"}
    facts = {"artifacts": artifacts, "configs": configs, **{k: table([], v) for k, v in empty.items()}}
    policy = Policy.from_mapping({"enabled_detectors": ["keras", "network", "secrets", "parse_error"]})
    found = {(r["artifact_id"], r["code"]) for r in registry.scan(facts, policy).collect()}
    assert ("a", "MLS-NET-002") in found and ("b", "MLS-PARSE-001") in found
    assert any(a == "a" and c.startswith("MLS-KERAS") for a, c in found)


def test_long_payloads_stay_whole(table):
    body = "x" * 9_000 + " last"
    config = {"class_name": "Lambda", "config": {"function": body}}
    df = table([("a", json.dumps(config))], "artifact_id string, config string")
    payloads = keras.payload_strings(keras.config_facts(df)).collect()
    assert [r["value"] for r in payloads] == [body]


def test_both_kinds_of_bomb_in_one_archive(table):
    rows = _archive(table, [(None, 2 * fixed.GIB // 1001, None, 1)] * 1001)
    artifacts = table([("a", "p", 100 * 1024, "pytorch", None)], ARTIFACT)
    found = {r["code"]: r for r in members.compression_findings(artifacts, rows).collect()}
    assert set(found) == {"MLS-CMP-001", "MLS-CMP-003"}
    assert set(found["MLS-CMP-003"]["details"]) == {"nested_count"}
    assert "nested_count" not in found["MLS-CMP-001"]["details"]
