"""The surrogate inputs of :mod:`ribospan.surrogates`, as DuckDB common table expressions."""

from ribospan.surrogates import BASES, LETTERS

WINDOWS = f"""
windows AS (
  SELECT doc_id * 1000000 + w - 1 AS rec_id, doc_id, source AS rbp, lang AS cell,
         source || '_' || lang AS dataset_id, CAST(doc_id % 2 AS INTEGER) AS label, seq
  FROM (
    SELECT doc_id, source, lang, unnest(tiles) AS seq, generate_subscripts(tiles, 1) AS w
    FROM (
      SELECT doc_id, source, lang, regexp_extract_all(
        translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}'),
        '.{{1,101}}') AS tiles
      FROM documents)))
"""

# Every position of every window, 1-based, in RNA letters.
CELLS = """
cells AS (
  SELECT rec_id, dataset_id, label, replace(seq, 'T', 'U') AS rna, i AS pos,
         substr(replace(seq, 'T', 'U'), i, 1) AS ch
  FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM windows))
"""


def grams(k: int, name: str = "grams", source: str = "windows", seq: str = "seq", cols: str = "*") -> str:
    return f"""
{name} AS (
  SELECT * EXCLUDE (i), i AS pos, substr({seq}, i, {k}) AS kmer
  FROM (SELECT {cols}, unnest(range(1, length({seq}) - {k} + 2)) AS i FROM {source}))
"""


VARIANTS = """
variants AS (
  SELECT rec_id, rbp, cell, dataset_id, seq,
    '>variant_' || rec_id || ' chr' || (doc_id % 22 + 1) || ':' || (rec_id * 1000) || '-'
      || (rec_id * 1000 + length(seq)) || CASE WHEN minus THEN '(-)' ELSE '(+)' END
      || '[utr]{NA} ' || (rec_id * 1000 + idx) || ':' || ref || '>' || translate(ref, 'ACGT', 'CGTA')
      || ' ENSG' || doc_id || '[0.01]{rs' || rec_id || '}' AS header
  FROM (
    SELECT *, CASE WHEN minus THEN translate(plus_ref, 'ACGT', 'TGCA') ELSE plus_ref END AS ref
    FROM (
      SELECT *, CASE WHEN shifted = '' THEN 'A' ELSE shifted END AS plus_ref, rec_id % 3 = 0 AS minus
      FROM (
        SELECT *, CASE WHEN rec_id % 7 = 0 THEN translate(base, 'ACGT', 'CGTA') ELSE base END AS shifted
        FROM (SELECT *, rec_id % 101 AS idx, substr(seq, CAST(rec_id % 101 AS INTEGER) + 1, 1) AS base
              FROM windows)))))
"""

CATALOG = """
catalog AS (
  SELECT rec_id, rbp, cell, dataset_id, seq,
    split_part(split_part(substr(header, 2), ' ', 2), '[', 1) || ' '
      || (CAST(split_part(split_part(header, ' ', 3), ':', 1) AS BIGINT)
          + CASE WHEN rec_id % 5 = 0 THEN 1 ELSE 0 END)
      || ':' || split_part(split_part(header, ' ', 3), ':', 2)
      || ' ' || rbp || ' in ' || cell AS header
  FROM variants)
"""

SCORES = """
scores AS (
  SELECT user_id AS variant, user_id AS rsid, event_id % 20 AS rbp, event_type AS cell,
         (value - 245.0::DOUBLE) / 100.0::DOUBLE AS ref_score,
         (CAST(json_extract_string(props, '$.k') AS DOUBLE) - 50.0::DOUBLE) / 20.0::DOUBLE AS alt_score,
         value / 5000.0::DOUBLE AS maf, event_id AS line_no
  FROM events)
"""

PVALUES = """
pvalues AS (
  SELECT o_custkey AS rsid, (o_totalprice % 1000.0::DOUBLE) / 1000.0::DOUBLE AS p_value,
         o_orderkey AS line_no
  FROM orders)
"""

PROFILES = """
profiles AS (
  SELECT vec_id AS rec_id, label AS grp, CAST(embedding AS DOUBLE[]) AS scores FROM embeddings)
"""

INTERVALS = """
intervals AS (
  SELECT l_returnflag AS rbp, CAST(l_linenumber AS VARCHAR) AS cell,
         CAST(l_suppkey % 5 AS VARCHAR) AS chrom, l_orderkey * 10 + l_partkey % 10 AS s,
         l_orderkey * 10 + l_partkey % 10 + CAST(l_quantity AS BIGINT) AS e
  FROM lineitem)
"""

PREDICTIONS = """
predictions AS (
  SELECT l_returnflag AS dataset_id, l_linenumber AS batch,
         CASE WHEN l_extendedprice + l_tax * 500000.0::DOUBLE > 45000.0::DOUBLE THEN 1 ELSE 0 END AS label,
         (l_quantity + l_discount * 100.0::DOUBLE) / 61.0::DOUBLE AS prob,
         l_extendedprice AS value, l_quantity AS quantity
  FROM lineitem)
"""
