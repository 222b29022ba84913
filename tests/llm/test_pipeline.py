"""The pipeline on a fixture, each stage against a plain version of its rule on its own input."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from ribospan.llm import language
from ribospan.llm.queries import QUERIES
from .test_language_blocks_nearest import prose
from .test_mixing_lines_secrets import kept_by_force, reshared
from .test_simhash_fingerprints import groups_by_force, mark_by_force
from .test_tokens_records_packing import crc, ids_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows = random.Random(21), []
    for k in range(220):
        lang = rng.choice(["en", "fr", "de", "es"])
        text = "\n".join(prose(rng, lang, rng.randint(6, 90)) for _ in range(rng.randint(1, 4)))
        rows.append((k, text, lang, rng.choice(["s0", "s0", "s1", "s2", None])))
    for k in range(220, 260):  # near copies, exact copies and a common line
        _, text, lang, source = rows[k - 210]
        words = text.split(" ")
        words[len(words) // 2] = "altered"
        rows.append((k, " ".join(words) if k % 3 else text, lang, source))
    rows = [(i, "Share this page with all your friends\n" + t if i % 5 == 0 else t, x, s) for i, t, x, s in rows]
    rows += [(300, None, "en", "s1"), (301, "", "fr", "s2"), (302, "*** 123", "de", "s0"), rows[3], (None, prose(rng, "en", 30), "en", "s1")]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return str(path)


def key(r):
    return tuple(r)


def test_every_stage_on_its_own_input(spark, folder, tmp_path):
    from tokenizers import Tokenizer

    from ribospan.llm.tokens import default_tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], folder).write.parquet(f"{tmp_path}/{k}")
        steps.append(spark.read.parquet(f"{tmp_path}/{k}"))
    for df in steps[1:-1]:
        assert df.columns == docs.columns
    raw, spoken, deduped, single, mixed, packed = ([*map(key, df.collect())] for df in steps)

    model = language.train(docs, language.F.lit(False))
    sets, _, fit = language.mixtures([r[1] or "" for r in raw], model)
    assert Counter(spoken) == Counter(r for r, some, x in zip(raw, sets.any(axis=1), fit, strict=True) if some and x > language.BLIND)
    assert not {300, 301, 302} & {r[0] for r in spoken} and len(spoken) >= len(raw) - 5

    forced = kept_by_force([(r[0], r[1]) for r in spoken])
    assert Counter((i, t) for i, _, t in forced if t.strip()) == Counter((r[0], r[1]) for r in deduped)
    assert all(r[4] == len(r[1]) for r in deduped)

    group = groups_by_force([mark_by_force(r[1]) for r in deduped])
    least = defaultdict(set)
    for r, g in zip(deduped, group, strict=True):
        least[g].add(10**9 if r[0] is None else r[0])
    assert sorted(min(v) for v in least.values()) == sorted(10**9 if r[0] is None else r[0] for r in single)

    sizes, taken = defaultdict(int), defaultdict(int)
    for r in single:
        sizes[r[3]] += len(r[1].split())
    for r in mixed:
        taken[r[3]] += len(r[1].split())
    assert all(abs(taken[s] - t) <= 150 for s, t in reshared(sizes).items())
    assert set(mixed) <= set(single) and max(Counter(mixed).values()) <= 2

    tokenizer = Tokenizer.from_file(default_tokenizer())
    want = Counter()
    for r in mixed:
        ids = ids_of(tokenizer, r[1])
        first = len(ids) - (len(ids) - 1) // 2048 * 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want.update((r[0], k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter(r[:5] for r in packed) == want
    fill = Counter()
    for r in packed:
        fill[r[5]] += r[3]
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1


def test_run_is_the_stages_in_turn(spark, folder):
    assert corpus_pipeline.run(spark, folder).select("doc_id").distinct().count() > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "source mixing", "best-fit packing"]


def test_stages_take_an_empty_table(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert np.all([n.startswith("op") for n in QUERIES])
