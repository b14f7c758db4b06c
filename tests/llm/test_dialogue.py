"""Conversation repair against a search over all edits, on random and odd conversations."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cargolens.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string"
_RIGHT = re.compile(r"(s?(ua)+)?")


def _faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        inner = text.strip(" \t\n\v\f\r")
        if not inner:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append(None if inner[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def _cheapest(rows, faults):
    """(cost, audit, lines): every edit string in turn, by a search without survivors."""

    def after(state, role):
        allowed = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
        return allowed[state].get(role)

    @functools.cache
    def best(i, state, opened):
        options = []
        if i == len(rows):
            if state in (0, 3):
                options.append((0, "", ()))
        else:
            _, role, text = rows[i]
            extra = faults[i] == "truncated"
            cost, audit, lines = best(i + 1, state, 0)
            options.append((cost + 3, "D" + audit, lines))
            if faults[i] not in ("blank", "duplicate"):
                for name, price, letter in ((role, 0, "K"), ("user", 2, "R"), ("assistant", 2, "R")):
                    then = after(state, name[:1])
                    if then is not None:
                        cost, audit, lines = best(i + 1, then, 0)
                        options.append((cost + price + extra, letter + audit, (f"{name}:{text}", *lines)))
        for name in ("user", "assistant"):
            then = after(state, name[:1])
            if then is not None and opened < 3:
                cost, audit, lines = best(i, then, opened + 1)
                options.append((cost + 2, "I" + audit, (f"{name}:", *lines)))
        return min(options, default=(10**9, "", ()))

    return best(0, 0, 0)


def _expected(conv_id, rows):
    rows = sorted(
        rows,
        key=lambda r: (
            r[0] is not None,
            r[0] or 0,
            r[1],
            hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest(),
        ),
    )
    faults = _faults(rows)
    cost, audit, lines = _cheapest(tuple(rows), tuple(faults))
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        conv_id,
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def _space(row):
    return (row[0], " " if row[1] is None else row[1], " " if row[2] is None else row[2])


def _talks():
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "tool", "", None, "s", "u"]
    texts = ["one.", "two", "three!", " \n", "", None, "four?\t ", "five"]
    talks = {None: [(0, "user", "a."), (1, "assistant", "b.")]}
    for conv_id in range(300):
        n, common = rng.randint(0, 9), rng.random()
        talks[conv_id] = [
            (
                rng.choice([None, *range(6)]),
                rng.choice(roles[:3] if rng.random() < common else roles),
                rng.choice(texts) if rng.random() < 0.5 else f"text {rng.randint(0, 99)}.",
            )
            for _ in range(n)
        ]
    talks[1000] = [(0, "system", "s.")]
    talks[1001] = [(i, "assistant", f"x{i}.") for i in range(40)]
    talks[1002] = [(0, "user", "u."), *[(i, "tool", f"x{i}.") for i in range(40)]]
    talks[1003] = [(i, "user", "same.") for i in range(60)]
    return talks


def test_repair_equals_a_search_over_all_edits(spark):
    talks = _talks()
    rows = [(c, *r) for c, rs in talks.items() for r in rs]
    roster = spark.createDataFrame([(c,) for c in talks], "conv_id long")
    turns = spark.createDataFrame(rows, SCHEMA)
    wide = turns.withColumns({c: F.lit("x") for c in ("kind", "digest", "first", "step", "fault")})
    got = {r.conv_id: r for r in dialogue.digests(dialogue.repair(wide, roster)).collect()}
    assert len(got) == len(talks)
    for conv_id, own in talks.items():
        r = got[conv_id]
        assert (
            r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit,
            r.repaired_sha256,
        ) == _expected(conv_id, [_space(x) for x in own]), own


def test_the_repaired_turns_alternate_and_follow_the_audit(spark):
    talks = _talks()
    rows = [(c, *r) for c, rs in talks.items() for r in rs]
    edits = dialogue.repair(spark.createDataFrame(rows, SCHEMA))
    found = {}
    for r in edits.where("edit IS NOT NULL").orderBy("conv_id", "step").collect():
        found.setdefault(r.conv_id, []).append(r)
    for conv_id, own in found.items():
        assert [r.step for r in own] == list(range(len(own)))
        assert sum(r.edit != "I" for r in own) == len(talks[conv_id])
        assert _RIGHT.fullmatch("".join(r.role[0] for r in own if r.edit != "D"))
        assert all(r.role is None and r.text is None for r in own if r.edit == "D")


def test_settled_rows_leave_memory():
    repair, most = dialogue.Repair(), 0
    for i in range(20_000):
        repair.turn(i, b"user" if i % 2 == 0 else b"assistant", b"x" * 50 + b".", None)
        most = max(most, len(repair._rows))
    assert most <= 4
    assert repair.end()[0] == 0


def test_long_unresolved_ties_take_linear_time():
    repair = dialogue.Repair()
    repair.turn(0, b"user", b"a.", None)
    for i in range(50_000):
        repair.turn(i, b"tool", b"b.", None)
    cost, edits = repair.end()
    assert cost == 2 * 49_999 + 3  # one turn too many for pairs
    assert len(edits) >= 50_000


@pytest.mark.parametrize("roster", [True, False])
def test_no_rows(spark, roster):
    empty = spark.createDataFrame([], SCHEMA)
    of = spark.createDataFrame([(7,), (7,), (None,)], "conv_id long")
    got = dialogue.digests(dialogue.repair(empty, of if roster else None)).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert sorted((tuple(r) for r in got), key=repr) == (
        [(7, 0, 0, 0, 0, 0, 0, "", nothing), (None, 0, 0, 0, 0, 0, 0, "", nothing)] if roster else []
    )


def test_damage(spark):
    rows = [(c, t, r, x) for c in (*range(40), None) for t in (0, None) for r, x in (("assistant", "a.b!"), (None, None))]
    expected = []
    for c, t, r, x in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        fault, r, x = zlib.crc32(key.encode()) % 20, r or " ", x or " "
        x = "" if fault == 1 else x.translate({ord(p): None for p in ".!?"}) if fault == 2 else x
        r = "user" if fault == 4 else r
        expected += [(c, t, r, x)] * {0: 0, 3: 2}.get(fault, 1)
    got = dialogue.damage(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_long_and_broken_texts(spark):
    rows = [(1, 0, "user", "word " * 400_000), (1, 1, "assistant", "ok."), (2, 0, "user", "x")]
    turns = spark.createDataFrame(rows, SCHEMA)
    broken = turns.withColumn("text", F.when(F.col("conv_id") == 2, F.unhex(F.lit("FF2E")).cast("string")).otherwise(F.col("text")))
    got = {r.conv_id: r for r in dialogue.digests(dialogue.repair(broken)).collect()}
    assert (got[1].truncated, got[1].cost, got[1].audit) == (1, 1, "KK")
    assert (got[2].truncated, got[2].audit) == (0, "KI")
