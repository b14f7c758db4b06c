"""Repair of conversation structure by a Viterbi search that emits as its survivors meet.

A repaired conversation is empty, or an optional system turn and then pairs of a user and an
assistant turn.  The cheapest edits are searched over four states: nothing yet, after the
system turn, after a user turn, after an assistant turn.  Each state has one survivor.  Their
edits stand in a tree of backpointers that counts references: what no survivor needs is
dropped, and once all share an ancestor the edits up to it are final and leave the task.  Of
equal costs the least edit letters win: survivors carry the order of their whole unresolved
paths from row to row, so a tie compares them without a walk back.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from cargolens.llm.common import CRC_TABLE_SQL, batch_of, crc32_sql, records

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
RETYPE_COST = INSERT_COST = 2
DELETE_COST = 3
TRUNCATED_COST = 1
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_ROLES = {_USER: b"user", _ASSISTANT: b"assistant"}
_LEGAL = {b"su", b"ua", b"au"}
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_ROWS, _BYTES = 2_000, 1 << 22


def damage(turns: DataFrame) -> DataFrame:
    """The turns with the faults that the crc32 of ``conv_id:turn`` modulo 20 names.

    0 drops a row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes its
    role user.  Nulls count as one space, but for conv_id and turn as columns.
    """
    space = F.lit(" ")
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    parts = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                        (F.crc32(F.concat_ws(":", *parts)) % 20).alias("fault"))
    fault = F.col("fault")
    return rows.where(fault != 0).select(
        "conv_id",
        "turn",
        F.when(fault == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, F.lit(""))
        .when(fault == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


class _Node:
    """The edits of one row after those of its parent: insertions, then the row's own."""

    __slots__ = ("parent", "label", "kids", "live")

    def __init__(self, parent: _Node | None, label: str):
        self.parent, self.label, self.kids, self.live = parent, label, [], True
        if parent is not None:
            parent.kids.append(self)


def _closed(found: dict[int, tuple]) -> dict[int, tuple]:
    """Survivors (cost, rank, letters) after insertions, without those that cannot win."""
    def inserted(state: int) -> tuple:
        cost, rank, letters = found[state]
        return cost + INSERT_COST, rank, letters + INSERT

    openers = [inserted(q) for q in (_START, _SYSTEM, _ASSISTANT) if q in found]
    found[_USER] = min([*openers, *([found[_USER]] if _USER in found else [])])
    answer = inserted(_USER)
    found[_ASSISTANT] = min(found.get(_ASSISTANT, answer), answer)
    found[_USER] = min(found[_USER], inserted(_ASSISTANT))
    best = found[_ASSISTANT]
    # After an assistant turn all can follow that can after the system turn; after nothing
    # one row more can be kept, the system turn, whose deletion costs DELETE_COST.
    if _SYSTEM in found and found[_SYSTEM] > best:
        del found[_SYSTEM]
    if _START in found and found[_START][0] > best[0] + DELETE_COST:
        del found[_START]
    return found


class Repair:
    """The edits of one conversation; ``turn`` takes its rows in order, ``end`` closes it.

    Both return the edits that have become final, as (edit, role, text, turn, fault).  What
    is held is the unresolved rows and at most four letters paths over them.
    """

    def __init__(self):
        self._root = _Node(None, "")
        self._cores = [self._root]  # the survivors' last rows, in the order of their paths
        self._found = _closed({_START: (0, 0, "")})  # (cost, place in cores, insertions since)
        self._rows: deque = deque()
        self._state = _START  # of what has been emitted

    def turn(self, turn: int | None, role: bytes, text: bytes, fault: str | None) -> list[tuple]:
        removed = fault in ("blank", "duplicate")
        extra = TRUNCATED_COST * (fault == "truncated")
        first = role[:1]
        new: dict[int, tuple] = {}

        def offer(state: int, survivor: tuple, cost: int, letter: str) -> None:
            made = (survivor[0] + cost, survivor[1], survivor[2] + letter)
            if state not in new or made < new[state]:
                new[state] = made

        for state, survivor in self._found.items():
            offer(state, survivor, DELETE_COST, DELETE)
            if removed:
                continue
            if state == _START and first == b"s":
                offer(_SYSTEM, survivor, extra, KEEP)
            then = _ASSISTANT if state == _USER else _USER
            if first == _ROLES[then][:1]:
                offer(then, survivor, extra, KEEP)
            else:
                offer(then, survivor, RETYPE_COST + extra, REROLE)
        self._rows.append((turn, role, None if removed else text, fault))
        self._take(_closed(new))
        return self._settled()

    def _take(self, found: dict[int, tuple]) -> None:
        """Makes the survivors' rows nodes of the tree and drops what none of them needs."""
        split = {}
        for state, (cost, rank, letters) in found.items():
            own = letters.rstrip(INSERT)
            split[state] = (cost, (rank, own), letters[len(own) :])
        order = sorted({core for _, core, _ in split.values()})
        before, place = self._cores, {core: i for i, core in enumerate(order)}
        self._cores = [_Node(before[rank], label) for rank, label in order]
        self._found = {q: (cost, place[core], rest) for q, (cost, core, rest) in split.items()}
        for node in before:
            node.live = False
            while node is not self._root and not node.kids and not node.live:
                node.parent.kids.remove(node)
                node = node.parent

    def _settled(self) -> list[tuple]:
        out: list[tuple] = []
        while not self._root.live and len(self._root.kids) == 1:
            self._root = self._root.kids[0]
            self._root.parent = None
            self._emit(self._root.label, out)
        return out

    def _emit(self, letters: str, out: list[tuple]) -> None:
        for letter in letters:
            then = _ASSISTANT if self._state == _USER else _USER
            if letter == INSERT:
                out.append((letter, _ROLES[then], b"", None, None))
                self._state = then
                continue
            turn, role, text, fault = self._rows.popleft()
            if letter == DELETE:
                out.append((letter, None, None, turn, fault))
            elif letter == KEEP:
                out.append((letter, role, text, turn, fault))
                self._state = _SYSTEM if role[:1] == b"s" else then
            else:
                out.append((letter, _ROLES[then], text, turn, fault))
                self._state = then

    def end(self) -> tuple[int, list[tuple]]:
        """The cost, and the edits that were still open."""
        cost, rank, rest = min(self._found[q] for q in (_START, _ASSISTANT) if q in self._found)
        node, labels = self._cores[rank], [rest]
        while node is not self._root:
            labels.append(node.label)
            node = node.parent
        out: list[tuple] = []
        for label in reversed(labels):
            self._emit(label, out)
        return cost, out


class _Conversation:
    """The faults of one conversation's rows, in order, and their repair."""

    def __init__(self):
        self.counts = dict.fromkeys(_COUNTS, 0)
        self._repair, self._last, self._initial = Repair(), None, None
        self._turns: list[int] = []  # least, greatest, how many

    def row(self, turn: int | None, role: bytes, text: bytes, digest: bytes, seen: bool) -> list:
        own, inner = (turn, digest), text.strip()
        if not inner:
            fault = "blank"
        elif seen or own == self._last:
            fault = "duplicate"
        else:
            fault = None if inner[-1:] in b".!?" else "truncated"
        if fault:
            self.counts[fault] += 1
        if self._initial is not None and self._initial + role[:1] not in _LEGAL:
            self.counts["illegal"] += 1
        if turn is not None:
            if not self._turns:
                self._turns = [turn, turn, 1]
            elif turn != self._turns[1]:
                self._turns[1:] = [turn, self._turns[2] + 1]
        self._last, self._initial = own, role[:1]
        return self._repair.turn(turn, role, text, fault)

    def close(self) -> list:
        self.counts["cost"], edits = self._repair.end()
        if self._turns:
            least, most, distinct = self._turns
            self.counts["gaps"] = most - least + 1 - distinct
        return edits


def _edit_schema(conv_id: StructField) -> StructType:
    return StructType(
        [
            conv_id,
            StructField("step", LongType()),
            StructField("edit", StringType()),
            StructField("role", BinaryType()),
            StructField("text", BinaryType()),
            StructField("turn", LongType()),
            StructField("fault", StringType()),
            *(StructField(c, LongType()) for c in _COUNTS),
        ]
    )


_MARK, _SEEN, _ROW = 0, 1, 2


def repair(turns: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """The edits that repair every conversation of (conv_id, turn, role, text), in order.

    A row an edit: conv_id, step, edit (K, R, D or I), role and text of the repaired turn
    (null for a deleted one), turn and fault of the source row.  After the last edit of a
    conversation, and for every conv_id of ``roster`` without rows, comes a row without edit
    that has its counts: gaps, blank, duplicate, truncated, illegal, cost.  The rows of a
    conversation stand in one partition, in order.

    Rows are taken by turn, null turns first, then by role and by a hash of the text; null
    roles and texts count as one space.  A null conv_id is a conversation.  Roles that begin
    with none of s, u and a can only be rewritten or deleted.  Other columns are not read; an
    empty table gives no rows.  A task streams its sorted rows and holds those whose edits
    are not settled; which rows repeat an earlier turn is found by aggregates beforehand.
    """
    space = F.lit(" ")
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
    )
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    rows = rows.withColumn("digest", F.unhex(F.sha2(whole.cast("binary"), 256)))
    # Null turns come first: a struct of nulls would count as less in any case, but min skips it.
    at = F.struct(F.col("turn").isNotNull().alias("named"), F.col("turn").alias("turn"))
    first = (
        rows.groupBy("conv_id", "digest")
        .agg(F.min(at).alias("first"), F.max(at).alias("last"))
        .where("first <> last")
        .select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_own"), "first")
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_own"))
    later = (
        rows.select("conv_id", "turn", "role", "digest")
        .join(first, same)
        .where(at > F.col("first"))
        .select("conv_id", "turn", "role", "digest")
        .distinct()
    )
    none = F.lit(None)
    parts = [
        rows.withColumn("kind", F.lit(_ROW)),
        later.select("*", none.cast("string").alias("text"), F.lit(_SEEN).alias("kind")),
    ]
    if roster is not None:
        parts.append(
            roster.select("conv_id").distinct().select(
                "conv_id",
                none.cast("long").alias("turn"),
                none.cast("string").alias("role"),
                none.cast("string").alias("text"),
                none.cast("binary").alias("digest"),
                F.lit(_MARK).alias("kind"),
            )
        )
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    order = ["conv_id", "turn", "role", "digest", "kind"]  # nulls first
    together = together.repartition("conv_id").sortWithinPartitions(*order)
    schema = _edit_schema(turns.select("conv_id").schema["conv_id"])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        current, talk, step, seen = None, None, 0, None

        def put(edits: list) -> None:
            nonlocal step, size
            for edit, role, text, turn, fault in edits:
                out.append((current[0], step, edit, role, text, turn, fault, *[None] * 6))
                step, size = step + 1, size + len(text or b"")

        def close() -> None:
            put(talk.close())
            counts = [talk.counts[c] for c in _COUNTS]
            out.append((current[0], step, None, None, None, None, None, *counts))

        for conv_id, turn, role, text, digest, kind in records(
            batches, "conv_id", "turn", "role", "text", "digest", "kind"
        ):
            if current != (conv_id,):
                if talk is not None:
                    close()
                current, talk, step, seen = (conv_id,), _Conversation(), 0, None
            if kind == _SEEN:
                seen = (turn, digest)
            elif kind == _ROW:
                put(talk.row(turn, role, text, digest, seen == (turn, digest)))
            if len(out) >= _ROWS or size > _BYTES:
                yield batch_of(arrow, out)
                out, size = [], 0
        if talk is not None:
            close()
        yield batch_of(arrow, out)

    edits = together.mapInArrow(run, schema)
    return edits.withColumn("role", _text("role")).withColumn("text", _text("text"))


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def digests(edits: DataFrame) -> DataFrame:
    """A row a conversation of what ``repair`` returned: its counts, all its edit letters and
    the SHA-256 of its repaired ``role:text`` lines.  Read in the order they have, no shuffle."""
    fields = edits.schema
    schema = StructType(
        [
            fields["conv_id"],
            *(fields[c] for c in _COUNTS),
            StructField("audit", StringType()),
            StructField("repaired_sha256", StringType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, audit, lines, digest = [], bytearray(), 0, hashlib.sha256()
        for conv_id, edit, role, text, *counts in records(
            batches, "conv_id", "edit", "role", "text", *_COUNTS
        ):
            if edit is None:
                out.append((conv_id, *counts, audit.decode(), digest.hexdigest()))
                audit, lines, digest = bytearray(), 0, hashlib.sha256()
                if len(out) >= _ROWS:
                    yield batch_of(arrow, out)
                    out = []
                continue
            audit += edit
            if role is not None:
                digest.update(b"\n" * (lines > 0) + role + b":" + text)
                lines += 1
        yield batch_of(arrow, out)

    return edits.mapInArrow(run, schema)


def _state(cost: str, letter: str, line: str | None, state: str) -> str:
    """SQL for a survivor after one more edit; a survivor is a struct of cost, audit, text."""
    text = f"{state}.x" if line is None else f"{state}.x || CASE WHEN {state}.x = '' THEN '' ELSE chr(10) END || {line}"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'x': {text}}}"


def _least(*options: str) -> str:
    return f"list_min(list_filter([{', '.join(options)}], lambda v: v.c IS NOT NULL))"


def _insertions(source: str) -> str:
    """SQL that closes the states n, s, u, a of ``source`` under insertions."""
    user, answer = ("2", INSERT, "'user:'"), ("2", INSERT, "'assistant:'")
    opened = _least(f"{source}.u", *[_state(*user, f"{source}.{q}") for q in "nsa"])
    return f"""
      SELECT * REPLACE ({_least("u", _state(*user, "a"))} AS u) FROM (
        SELECT * REPLACE ({_least("a", _state(*answer, "u"))} AS a) FROM (
          SELECT {source}.* REPLACE ({opened} AS u) FROM {source}))"""


def _sql() -> str:
    kind = "STRUCT(c BIGINT, a VARCHAR, x VARCHAR)"
    void = f"CAST(NULL AS {kind})"
    line = "role || ':' || text"
    removed = "fault IN ('blank', 'duplicate')"

    def from_row(new: str, keeps: str, old: str, told: str | None) -> str:
        options = [_state("3", DELETE, None, new)]
        for q in old:
            kept = _state("extra", KEEP, line, q)
            options.append(f"CASE WHEN NOT removed AND initial = '{keeps}' THEN {kept} END")
            if told:
                moved = _state("2 + extra", REROLE, f"'{told}:' || text", q)
                options.append(f"CASE WHEN NOT removed THEN {moved} END")
        return _least(*options)

    return f"""
WITH RECURSIVE crc AS ({CRC_TABLE_SQL}),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
hashed AS (SELECT k, {crc32_sql("k")} % 20 AS f FROM (SELECT DISTINCT k FROM keyed), crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM keyed JOIN hashed USING (k) WHERE f <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role,
           sha256(length(role) || ':' || role || text), copy) AS pos,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM damaged),
rated AS (
  SELECT *, substr(role, 1, 1) AS initial, CASE
           WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
           WHEN nth > 1 THEN 'duplicate'
           WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' END AS fault
  FROM placed),
rows AS (
  SELECT *, coalesce({removed}, false) AS removed, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS extra,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM rated),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM rows GROUP BY conv_id),
opening AS (
  SELECT conv_id, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'a': '', 'x': ''}}::{kind} AS n,
         {void} AS s, {void} AS u, {void} AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)),
states AS (
  {_insertions("opening")}
  UNION ALL
  SELECT * FROM (
    WITH stepped AS (
      SELECT states.conv_id, rows.pos, {_state("3", DELETE, None, "n")} AS n,
             {from_row("s", "s", "n", None)} AS s, {from_row("u", "u", "nsa", "user")} AS u,
             {from_row("a", "a", "u", "assistant")} AS a
      FROM states JOIN rows ON states.conv_id IS NOT DISTINCT FROM rows.conv_id AND rows.pos = states.pos + 1)
    {_insertions("stepped")})),
ended AS (
  SELECT states.conv_id, {_least("states.n", "states.a")} AS best
  FROM states LEFT JOIN counts ON states.conv_id IS NOT DISTINCT FROM counts.conv_id
  WHERE states.pos = coalesce(counts.n, 0))
SELECT ended.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit,
       sha256(best.x) AS repaired_sha256
FROM ended LEFT JOIN counts ON ended.conv_id IS NOT DISTINCT FROM counts.conv_id
"""


SQL = _sql()
