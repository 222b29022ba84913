import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from ribospan.llm import turn_repair
from ribospan.llm.turn_repair import Repair, Search

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest_by_force(rows):
    """All edits of ``(initial, must_go, cut_off)``, with up to two insertions in each gap: cost and initials."""
    best = None
    for inserts in itertools.product(range(3), repeat=len(rows) + 1):
        for edits in itertools.product("DKR", repeat=len(rows)):
            cost, roles, audit, right = 0, "", "", True
            expected = lambda: "a" if roles[-1:] == "u" else "u"  # noqa: E731, B023
            for gap in range(len(rows) + 1):
                for _ in range(inserts[gap]):
                    roles, cost, audit = roles + expected(), cost + 2, audit + "I"
                if gap == len(rows):
                    break
                initial, must_go, cut_off = rows[gap]
                edit = edits[gap]
                right = right and (edit == "D" or not must_go)
                audit += edit
                cost += {"D": 3, "K": 0, "R": 2}[edit] + (cut_off and edit != "D")
                roles += {"D": "", "K": initial, "R": expected()}[edit]
            if right and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_search_against_all_edits(seed):
    rng = random.Random(seed)
    for _ in range(60):
        rows = [(rng.choice("suat"), rng.random() < 0.15, rng.random() < 0.3) for _ in range(rng.randrange(5))]
        audit = []
        search = Search(lambda edit, turn: audit.append(edit))
        for initial, must_go, cut_off in rows:
            search.add(initial, "x", initial, must_go, cut_off)
        assert (search.finish(), "".join(audit)) == cheapest_by_force(rows)


def search_whole(rows):
    """The same search with whole strings for each state, no tree and nothing dropped."""
    best = {0: (0, "")}

    def inserted(found):
        for _ in range(4):
            for s in sorted(found):
                cost, audit = found[s]
                after = turn_repair.MADE[s][1]
                found[after] = min(found.get(after, (10**9, "")), (cost + 2, audit + "I"))
        return found

    best = inserted(best)
    for initial, must_go, cut_off in rows:
        found = {}
        for s, (cost, audit) in best.items():
            options = [(s, cost + 3, "D")]
            if not must_go:
                options.append((turn_repair.MADE[s][1], cost + 2 + cut_off, "R"))
                if (s, initial) in turn_repair.KEPT:
                    options.append((turn_repair.KEPT[s, initial], cost + cut_off, "K"))
            for t, c, e in options:
                found[t] = min(found.get(t, (10**9, "")), (c, audit + e))
        best = inserted(found)
    return min(best[s] for s in (0, 3) if s in best)


@pytest.mark.parametrize("roles", ["suat", "ua", "u", "t", "sssu"])
def test_long_searches_agree_and_hold_little(roles):
    rng = random.Random(len(roles))
    for n in (30, 200):
        rows = [(rng.choice(roles), rng.random() < 0.1, rng.random() < 0.2) for _ in range(n)]
        audit, most = [], 0
        search = Search(lambda edit, turn: audit.append(edit))
        for initial, must_go, cut_off in rows:
            search.add(initial, "x", initial, must_go, cut_off)
            most = max(most, search.unresolved())
        assert (search.finish(), "".join(audit)) == search_whole(rows)
        if roles in ("suat", "ua"):
            assert most < 60  # edits are final soon after


def test_what_never_coalesces_is_still_decided_in_linear_time():
    audit = []
    search = Search(lambda edit, turn: audit.append(edit))
    for _ in range(20_000):  # no row can be kept: two ways stay open to the end
        search.add("tool", "x", "t", False, False)
    assert search.finish() == 40_000 and "".join(audit) == "R" * 20_000


def test_memory_of_a_regular_conversation_does_not_grow():
    sizes = []
    search = Search(lambda edit, turn: None)
    for k in range(5000):
        search.add("user" if k % 2 == 0 else "assistant", "x", "ua"[k % 2], False, False)
        sizes.append(search.unresolved())
    assert max(sizes) < 12 and search.finish() == 0


def report_by_force(rows):
    """The contract in plain Python, with the search that is tested above."""
    by_conv = {}
    for conv_id, turn, role, text in rows:
        by_conv.setdefault(conv_id, [])
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        by_conv[conv_id] += [(turn, role, text)] * (2 if fault == 3 else 1)
    out = []
    for conv_id, turns in by_conv.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, hashlib.md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest()))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        counts, seen, plain = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, role, text in turns:
            words = text.strip(" \t\n\v\f\r")
            fault = "blank" if not words else "duplicate" if (role, text) in seen else None if words[-1] in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            plain.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit = search_whole(plain)
        repaired, k = [], 0
        for edit in audit:
            made = "assistant" if repaired and repaired[-1][:1] == "u" else "user"
            if edit == "I":
                repaired.append(f"{made}:")
                continue
            _, role, text = turns[k]
            k += 1
            if edit != "D":
                repaired.append(f"{role if edit == 'K' else made}:{text}")
        digest = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        out.append((conv_id, gaps, *counts.values(), illegal, cost, audit, digest))
    return sorted(map(str, out))


def odd_rows():
    rng, rows = random.Random(2), []
    for c in range(60):
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "open end", "", None, " \t\n", "What? ", "Ünd so.\n", "long " * 50])
            rows.append((c, rng.choice([turn, turn, turn, None, turn + 3]), role, text))
    rows += [(500, t, "user", "same text.") for t in range(40)] + [(None, 1, "user", "a."), (None, None, "assistant", "b."), (501, None, None, None)]
    return [*rows, rows[5], rows[5]]


def test_report_against_brute_force_and_sql(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit("clash")).withColumn("nth", F.lit(1)).withColumn("fault", F.lit(2))
    found = sorted(str(tuple(r)) for r in turn_repair.repair_damaged(df).collect())
    assert found == report_by_force(rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(map(str, con.execute(turn_repair.ORACLE).fetchall())) == found


def test_empty_table_and_small_batches(spark):
    assert not turn_repair.repair_damaged(spark.createDataFrame([], SCHEMA)).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = odd_rows()
        found = turn_repair.repair_damaged(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(str(tuple(r)) for r in found) == report_by_force(rows)


def test_conversation_without_rows_after_damage():
    nothing = Repair(7).result()
    assert nothing == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
