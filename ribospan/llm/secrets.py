r"""Secret scans over a trigram inverted index, in DataFrame functions only.

From every rule's regular expression comes a Boolean query over trigrams
(:mod:`ribospan.llm.trigrams`). The index holds postings (trigram, document) of the trigrams that
the rules' queries name; its conjunctions are intersected by counting a document's postings of
each, and only documents that satisfy a rule's query are verified with its expression. Rules
without mandatory trigrams (long hex strings) scan every text.

Spans are in code points, end exclusive, and come from the pieces between matches: where a match
begins is the length of all that lies before it.

Edge cases: a null or empty text has no span (its digest is that of the empty string); null ids
and repeated rows keep a row each, and rows equal in id and text are one document of the index;
very long texts are scanned whole; an empty table gives an empty result; extra columns are left
out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ribospan.functions.core import let
from ribospan.llm.trigrams import trigram_query
from ribospan.session import materialize


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 1  # characters of ``group`` in a match that counts
    group: int = 0
    sieve: str = ""  # a cheaper pattern that every text with a match that counts has


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGNED = "(" + "|".join(
    [_either_case("password"), _either_case("passwd"), _either_case("secret"), _either_case("token"),
     _either_case("api") + "_?" + _either_case("key")]
) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

BASE = (
    Rule("assign", ASSIGNED, 6, 2),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]+", 24, sieve="[0-9a-f]{24}"),
)
# Formats that issuers publish for their keys.
MORE = (
    Rule("private", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", "AIza[0-9A-Za-z_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index: ``trigram, key`` of every distinct document of ``docs(key, text)`` that holds it."""
    low = docs.select("key", F.lower("text").alias("low"))
    held = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("low"), t))
    return low.select("key", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """``key, kinds``: the documents that satisfy a rule's query, with those rules.

    Postings meet the conjunctions that name their trigram (a fixed table of the rules), and a
    document satisfies a conjunction if it has as many postings as that has trigrams.
    """
    spark = index.sparkSession
    clauses = [(k, i, t, len(c)) for k, q in queries.items() for i, c in enumerate(q) for t in sorted(c)]
    named = spark.createDataFrame(clauses, "kind string, clause int, trigram string, needed int")
    met = (
        index.join(F.broadcast(named), "trigram")
        .groupBy("key", "kind", "clause", "needed")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == F.col("needed"))
    )
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def spans_of(rule: Rule, text: Column, portion: int = 256) -> Column:
    """Array of ``(start, end, kind)`` of the matches that count.

    Matches are gone through in portions, so that the array that grows with each match stays short.
    """
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    pieces = F.split(text, rule.pattern, -1)
    rows = F.arrays_zip(pieces.alias("piece"), matches.alias("match"), counted.alias("counted"))
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def step(state: Column, row: Column) -> Column:
        begin = state["place"] + F.length(row["piece"])
        end = begin + F.coalesce(F.length(row["match"]), F.lit(0))
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        keep = row["match"].isNotNull() & (F.length(row["counted"]) >= rule.least)
        return F.struct(
            end.alias("place"), F.when(keep, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans")
        )

    def portion_step(state: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(state["place"].alias("place"), empty.alias("spans")), step)
        return let(done, lambda d: F.struct(d["place"].alias("place"), F.concat(state["spans"], F.array(d["spans"])).alias("spans")))

    def walk(found: Column) -> Column:
        last = F.floor((F.size(found) - 1) / portion).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(found, k * portion + 1, F.lit(portion)))
        start = F.struct(F.lit(0).alias("place"), F.array().cast("array<array<struct<start:int,end:int,kind:string>>>").alias("spans"))
        return F.aggregate(parts, start, portion_step, lambda s: F.flatten(s["spans"]))

    return let(rows, walk)


def joined(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` by start, then kind as listed."""
    place = F.array(*[F.lit(k) for k in kinds])
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(place, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    return F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """Spans of every row of ``docs(doc_id, text)``: ``doc_id``, a column of spans for each kind."""
    rules = [*base, *more]
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not None}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    trigrams = sorted({t for q in indexed.values() for c in q for t in c})
    # A posting counts once, however often rows equal in id and text are repeated.
    index = materialize(postings(rows.select("key", "text"), trigrams).distinct())
    found = materialize(candidates(index, indexed))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    # Only candidates' texts move to be verified; a text that is none meets the rules without trigrams where it is read.
    flagged = rows.join(found, "key", "left")
    columns = []
    for r in rules:
        suspect = F.array_contains("kinds", r.kind) if r.kind in indexed else F.col("text").rlike(r.sieve or r.pattern)
        columns.append(F.when(suspect, spans_of(r, F.col("text"))).otherwise(none).alias(f"s_{r.kind}"))
    return flagged.select("doc_id", *columns)


def scan_report(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    base, every = [r.kind for r in BASE], [r.kind for r in (*BASE, *MORE)]
    of = lambda kinds: F.concat(*[F.coalesce(F.col(f"s_{k}"), F.array().cast("array<struct<start:int,end:int,kind:string>>")) for k in kinds])
    return found.select(
        "doc_id",
        *[F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in base],
        F.sha2(joined(of(base), every), 256).alias("base_sha256"),
        joined(of(every), every).alias("spans"),
    )


def _listed(rule: Rule) -> str:
    """The rule's pattern in SQL; runs of one class are cut off at their least length there already."""
    plain = rule.sieve.replace("}", ",}") if rule.sieve else rule.pattern
    return plain.replace("'", "''")


def oracle() -> str:
    """The same in DuckDB: every text, every rule, no index."""
    parts = []
    for k, r in enumerate((*BASE, *MORE)):
        p = _listed(r)
        counted = f"regexp_extract_all(t, '{p}', {r.group})"
        parts.append(
            f"[x for x in [{{'k': {k}, 'kind': '{r.kind}', 'len': len(g), "
            f"'start': coalesce(list_sum([len(x) for x in p[:i]]), 0) + coalesce(list_sum([len(x) for x in m[:i-1]]), 0), "
            f"'end': coalesce(list_sum([len(x) for x in p[:i]]), 0) + coalesce(list_sum([len(x) for x in m[:i]]), 0)}} "
            f"for g, i in {counted}] if x.len >= {r.least}]".replace("p[:i]", f"p{k}[:i]").replace("m[:i", f"m{k}[:i")
        )
    splits = ", ".join(
        f"regexp_split_to_array(t, '{_listed(r)}') AS p{k}, regexp_extract_all(t, '{_listed(r)}') AS m{k}"
        for k, r in enumerate((*BASE, *MORE))
    )
    text = lambda s: f"array_to_string([x.kind || ':' || x.start || ':' || x.end for x in list_sort({s}, 'ASC')], ',')"
    row = "{'start': x.start, 'k': x.k, 'end': x.end, 'kind': x.kind}"
    every = "list_concat(" * (len(parts) - 1) + parts[0] + "".join(f", {p})" for p in parts[1:])
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
cut AS (SELECT doc_id, t, {splits} FROM docs),
found AS (SELECT doc_id, [{row} for x in {every}] AS spans FROM cut)
SELECT doc_id,
       len([x for x in spans if x.k = 0]) AS n_assign, len([x for x in spans if x.k = 1]) AS n_access,
       len([x for x in spans if x.k = 2]) AS n_hex,
       sha256({text("[x for x in spans if x.k < 3]")}) AS base_sha256,
       {text("spans")} AS spans
FROM found
"""
