"""Cheapest repair of a conversation's turns: a Viterbi search with coalescing survivors.

A repaired conversation has the roles ``(s?(ua)+)?`` by their initials. A row can be kept, given the
other role of its place, or deleted, and empty turns can be inserted; costs are below. A search over
four states (nothing yet, after ``s``, after ``u``, after ``a``) keeps the best edits that lead to
each. Survivors end in a tree of back pointers with counts of references: branches nobody
refers to go, and as soon as all survivors share an ancestor the edits up to it are final and are
emitted, so memory holds the unresolved edits of one conversation only. A survivor that another
one can stand in for at less cost, whatever follows, is dropped; without that, "delete
everything" would stay in the race and nothing would ever coalesce.

Of equal costs the edits whose initials are least in ASCII win. That comparison is of the complete
unresolved edits; for each two survivors the search carries what is left of both after their common
part, which decides it without walking back. (Survivors of equal cost are never one the beginning
of the other: both have an edit for each row so far, and an insertion costs.)

Spark sorts each conversation's rows and finds repeated ones by a window of its own; a
task streams through the conversations of its partition.

Edge cases: null ids, roles, texts and turns are one space where they are spelled out; rows with a
null id are one conversation; equal turns are ordered by a digest of role and text; repeated
rows are rows; very long texts are held while unresolved; a conversation without rows is empty and
costs nothing; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ribospan.llm.prefix_trie import CRC_TABLE, crc_sql

START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The turn that may be inserted, or a row be turned into, in each state, and the state after it.
MADE = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
ENDS = (START, ASSISTANT)
CHANGE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: What it costs at most to do from the second state whatever can follow the first.
STAND_IN = {(START, SYSTEM): 4, (START, USER): 5, (START, ASSISTANT): 3, (SYSTEM, START): 0, (SYSTEM, USER): 2, (SYSTEM, ASSISTANT): 0}
LEGAL = {"su", "ua", "au"}


class Back:
    """A node of the tree: an edit, the turn it leaves, and how many nodes and survivors refer to it."""

    __slots__ = ("above", "edit", "turn", "below", "survivors")

    def __init__(self, above: Back | None, edit: str, turn: str | None) -> None:
        self.above, self.edit, self.turn = above, edit, turn
        self.below: list[Back] = []
        self.survivors = 0
        if above is not None:
            above.below.append(self)


def _rest(a: str, b: str) -> tuple[str, str]:
    """What is left of two edit strings after their common part; one character each if that decides."""
    k, most = 0, min(len(a), len(b))
    while k < most and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    return (a[0], b[0]) if a and b else (a, b)


class Search:
    """Best edits of one conversation, row by row."""

    def __init__(self, emit) -> None:
        self.emit, self.root = emit, Back(None, "", None)
        self.best = {START: (0, self.root)}
        self.root.survivors = 1
        self.rests = {}
        self._advance({START: (0, START, "")}, {START: None})

    def _less(self, one: tuple, other: tuple) -> bool:
        if one[0] != other[0]:
            return one[0] < other[0]
        a, b = self.rests.get((one[1], other[1]), ("", ""))
        return a + one[2] < b + other[2]

    def add(self, role: str, text: str, initial: str, must_go: bool, cut_off: bool) -> None:
        picks, turns = {}, {}

        def offer(state, cost, source, edit, turn):
            found = (cost, source, edit)
            if state not in picks or self._less(found, picks[state]):
                picks[state], turns[state] = found, turn

        for source, (cost, _) in self.best.items():
            offer(source, cost + DELETE, source, "D", None)
            if must_go:
                continue
            kept = KEPT.get((source, initial))
            if kept is not None:
                offer(kept, cost + cut_off * CUT_OFF, source, "K", f"{role}:{text}")
            made, state = MADE[source]
            offer(state, cost + CHANGE + cut_off * CUT_OFF, source, "R", f"{made}:{text}")
        self._advance(picks, turns)

    def _advance(self, picks: dict, turns: dict) -> None:
        """Add insertions to the picks of a row, drop who is beaten, and grow the tree."""
        final = {state: (*pick, state, 0) for state, pick in picks.items()}
        changed = True
        while changed:
            changed = False
            for state in sorted(final):
                cost, source, edits, base, inserted = final[state]
                found = (cost + INSERT, source, edits + "I", base, inserted + 1)
                after = MADE[state][1]
                if after not in final or self._less(found, final[after]):
                    final[after], changed = found, True
        for state in [s for s in final if any((s, t) in STAND_IN and final[s][0] > final[t][0] + STAND_IN[s, t] for t in final)]:
            del final[state]
        old, nodes = self.best, {}

        def node(base: int, inserted: int) -> Back:
            if (base, inserted) not in nodes:
                if inserted:
                    above = node(base, inserted - 1)
                    state = base
                    for _ in range(inserted - 1):
                        state = MADE[state][1]
                    nodes[base, inserted] = Back(above, "I", f"{MADE[state][0]}:")
                else:
                    _, source, edit = picks[base]
                    nodes[base, 0] = Back(old[source][1], edit, turns[base]) if edit else old[source][1]
            return nodes[base, inserted]

        self.best = {state: (cost, node(base, inserted)) for state, (cost, _, _, base, inserted) in final.items()}
        for _, back in self.best.values():
            back.survivors += 1
        for _, back in old.values():
            back.survivors -= 1
            while back is not self.root and not back.survivors and not back.below:
                back.above.below.remove(back)
                back = back.above
        rests = {}
        for s, (_, source, edits, *_) in final.items():
            for t, (_, other, others, *_) in final.items():
                if s != t:
                    a, b = self.rests.get((source, other), ("", ""))
                    rests[s, t] = _rest(a + edits, b + others)
        self.rests = rests
        while not self.root.survivors and len(self.root.below) == 1:
            self.root = self.root.below[0]
            self.root.above = None
            self.emit(self.root.edit, self.root.turn)

    def unresolved(self) -> int:
        """Nodes that the tree holds."""
        held, stack = 0, [self.root]
        while stack:
            back = stack.pop()
            held += 1
            stack += back.below
        return held

    def finish(self) -> int:
        """Emit the rest of the cheapest edits; their cost."""
        ending = None
        for state in ENDS:
            if state in self.best and (ending is None or self._less((self.best[state][0], state, ""), (self.best[ending][0], ending, ""))):
                ending = state
        cost, back = self.best[ending]
        path = []
        while back is not self.root:
            path.append(back)
            back = back.above
        for back in reversed(path):
            self.emit(back.edit, back.turn)
        return cost


RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
RESULT_SCHEMA = ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'long'}" for c in RESULT)


class Repair:
    """Counts, edits and the digest of one conversation whose rows come in order."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.audit, self.digest, self.any_turn = conv_id, [], hashlib.sha256(), False
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.before = 0, None
        self.first = self.last = None
        self.distinct = 0
        self.search = Search(self.emit)

    def emit(self, edit: str, turn: str | None) -> None:
        self.audit.append(edit)
        if turn is not None:
            self.digest.update(("\n" + turn if self.any_turn else turn).encode())
            self.any_turn = True

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.distinct = turn, self.distinct + 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        if fault:
            self.faults[fault] += 1
        self.search.add(role, text, initial, fault in ("blank", "duplicate"), fault == "truncated")

    def result(self) -> tuple:
        cost = self.search.finish()
        gaps = self.last - self.first + 1 - self.distinct if self.first is not None else 0
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, cost, "".join(self.audit), self.digest.hexdigest())


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of ``turns(conv_id, turn, role, text)`` with the faults that a checksum of their place gives them.

    Dropped rows stay, with ``dropped`` set, for the ids of their conversations.
    """
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        spelled("role").alias("role"),
        spelled("text").alias("text"),
        (F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn")).cast("binary")) % 20).alias("fault"),
    )
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("dropped"), F.explode(copies).alias("one")).drop("one")


def first_faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``digest``, ``nth`` (of equal rows of a conversation, in order) and ``first_fault``."""
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    same = Window.partitionBy("conv_id", "dropped", "digest").orderBy(F.col("turn").asc_nulls_first())
    numbered = rows.withColumn("digest", digest).withColumn("nth", F.row_number().over(same))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank")
        .when(F.col("nth") > 1, "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )
    return numbered.withColumn("first_fault", fault)


def repair_report(rows: DataFrame) -> DataFrame:
    """One row a conversation of ``rows(conv_id, turn, role, text, dropped)``: its faults, the cheapest edits and a digest of the result."""

    def run(found):
        here = None
        for batch in found:
            out = []
            for conv_id, turn, role, text, dropped, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here is None or here.conv_id != conv_id:
                    if here is not None:
                        out.append(here.result())
                    here = Repair(conv_id)
                if not dropped:
                    here.add(turn, role, text, fault)
            yield _rows(out)
        if here is not None:
            yield _rows([here.result()])

    ordered = first_faults(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest", "nth")
    return ordered.select("conv_id", "turn", "role", "text", "dropped", "first_fault").mapInArrow(run, RESULT_SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(RESULT)
    kinds = [pa.string() if c in ("audit", "repaired_sha256") else pa.int64() for c in RESULT]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=RESULT)


def repair_damaged(turns: DataFrame) -> DataFrame:
    """Repair of the damaged rows of ``turns(conv_id, turn, role, text)``, one row an original conversation."""
    return repair_report(damaged(turns))


def _oracle() -> str:
    def edited(state, cost, edit, turn=None):
        turns = f"list_append({state}.t, {turn})" if turn else f"{state}.t"
        return f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{edit}', t := {turns})"

    never = "struct_pack(c := 1000000000, a := '', t := []::VARCHAR[])"
    cut = "cut::INTEGER"
    delete = lambda s: edited(s, DELETE, "D")
    keep = lambda s, i: f"CASE WHEN NOT gone AND initial = '{i}' THEN {edited(s, cut, 'K', 'line')} ELSE {never} END"
    change = lambda s, role: f"CASE WHEN NOT gone THEN {edited(s, f'{CHANGE} + {cut}', 'R', repr(role + ':') + ' || text')} ELSE {never} END"
    insert = lambda s, role: edited(s, INSERT, "I", repr(role + ":"))
    after_row = [
        delete("s0"),
        f"least({delete('s1')}, {keep('s0', 's')})",
        "least(" + ", ".join([delete("s2"), *[f(s, x) for s in ("s0", "s1", "s3") for f, x in ((keep, "u"), (change, "user"))]]) + ")",
        f"least({delete('s3')}, {keep('s2', 'a')}, {change('s2', 'assistant')})",
    ]

    def with_inserts(source: str) -> str:
        """Two rounds of insertions over ``source(conv_id, i, s0..s3)``."""
        for _ in range(2):
            source = (
                f"SELECT conv_id, i, s0, s1, least(s2, {insert('s0', 'user')}, {insert('s1', 'user')}, {insert('s3', 'user')}) AS s2, "
                f"least(s3, {insert('s2', 'assistant')}) AS s3 FROM ({source})"
            )
        return source

    begin = f"SELECT DISTINCT conv_id, 0::BIGINT AS i, struct_pack(c := 0, a := '', t := []::VARCHAR[]) AS s0, {never} AS s1, {never} AS s2, {never} AS s3 FROM damaged"
    step = "SELECT s.conv_id, r.i, " + ", ".join(f"{x} AS s{k}" for k, x in enumerate(after_row)) + (
        " FROM search s JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1"
    )
    return rf"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {CRC_TABLE} AS crc_table),
rows AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fault FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         fault = 0 AS dropped, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM rows),
numbered AS (
  SELECT *, md5(length(role) || ':' || role || text) AS digest,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM damaged WHERE NOT dropped),
marked AS (
  SELECT *, role[1:1] AS initial, role || ':' || text AS line,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest, nth) AS i,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open_end
  FROM numbered),
faulty AS (
  SELECT *, blank OR nth > 1 AS gone, NOT blank AND nth = 1 AND open_end AS cut,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM marked),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (NOT blank AND nth > 1) AS duplicate, count(*) FILTER (cut) AS truncated,
         count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faulty GROUP BY conv_id),
search AS (
  {with_inserts(begin)}
  UNION ALL
  {with_inserts(step)}),
ended AS (
  SELECT s.conv_id, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, least(s0, s3) AS e
  FROM search s LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id WHERE s.i = coalesce(c.n, 0))
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, e.c::BIGINT AS cost, e.a AS audit,
       sha256(array_to_string(e.t, chr(10))) AS repaired_sha256
FROM ended
"""


ORACLE = _oracle()
