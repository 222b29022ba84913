import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ribospan.llm import packing, records
from ribospan.llm.tokens import Encoder, batches, default_tokenizer

DOCS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = ["the", "ether.", "Ölen,", "x1", "don't", "a_b", "…", "naïve", "end."]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), "en") for k in range(60)]
    rows += [(100, None, None), (101, "", "en"), (102, "word " * 9000, "en"), (103, "a  b\t\nc <|endoftext|> d \n", "en")]
    rows += [rows[3], rows[3], (None, "no id", "en"), (None, None, "en"), (104, "  lead\n\n\ntrail  ", None)]
    return spark.createDataFrame(rows, DOCS), rows


def test_words_in_turn_give_the_ids_of_the_whole_text(tokenizer):
    known, rng = Encoder(default_tokenizer(), max_words=50), random.Random(1)
    parts = [" ", "\n", "a", "Bc", "é", "1", ".", ",", "'s", "\t", "_", "<|endoftext|>", "\r", " ", "\0", "字", "of", " the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    for i, j in batches(texts, 500):
        for text, raw in zip(texts[i:j], known.encode(texts[i:j]), strict=True):
            assert np.frombuffer(raw, known.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_records_round_trip(spark, docs, tokenizer):
    df, rows = docs
    got = records.token_round_trip(df.withColumn("shard", F.lit(7)), default_tokenizer(), shard_bytes=5000).collect()
    assert len(got) == len(rows)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    starts, at = {}, 0
    for doc_id, text, _ in ordered:
        starts.setdefault(doc_id, []).append(at)
        at += len(ids_of(tokenizer, text))
    for r in got:
        texts = [t for i, t, _ in rows if i == r.doc_id]
        assert (r.n_tokens, r.ids_crc32) in {(len(x), crc(x)) for x in (ids_of(tokenizer, t) for t in texts)}
        if r.doc_id is not None:
            assert r.start in starts[r.doc_id]
    covered = sorted((r.start, r.n_tokens) for r in got)
    assert covered[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(covered, covered[1:]))
    assert sum(covered[-1]) == at


def test_records_of_an_empty_table(spark):
    assert records.token_round_trip(spark.createDataFrame([], DOCS), default_tokenizer()).count() == 0


def test_a_damaged_record_is_an_error():
    framed = bytearray(records.frame(b"\x01\x02\x03\x04"))
    framed[13] ^= 1
    place = iter([bytes(framed[:12]), bytes(framed[12:])])
    with pytest.raises(ValueError, match="damaged"):
        records.unframe(lambda n: next(place), "here")


def test_pieces_and_sequences(spark, docs, tokenizer):
    df, rows = docs
    got = packing.pack_documents(df.withColumn("bin", F.lit(1)), default_tokenizer(), 256, leaf_items=8, fan_in=2).collect()
    expected = []
    for doc_id, text, _ in rows:
        ids = ids_of(tokenizer, text)
        first = len(ids) - (len(ids) - 1) // 256 * 256
        cuts = [0, *range(first, len(ids) + 1, 256)]
        expected += [(doc_id, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(map(str, expected)) == sorted(str(tuple(r)[:5]) for r in got)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in places.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and sum(v[-1]) <= 256
    assert len(places) <= -(-sum(r.length for r in got) // 256) + 3


def test_packing_needs_few_more_sequences_than_the_bound(spark):
    rng = random.Random(2)
    rows = [(k, 0, 0, rng.choice([rng.randint(1, 2047), rng.randint(1000, 1300), 1100]), 0) for k in range(6000)]
    packed = packing.pack(spark.createDataFrame(rows, packing.PIECE), 2048, leaf_items=500, fan_in=3)
    sizes = [r.n for r in packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert packed.count() == 6000 and max(sizes) <= 2048
    bins, _ = packing.best_fit(np.array([r[3] for r in rows]), 2048)
    assert len(sizes) <= 1.01 * (bins.max() + 1)


def test_items_that_never_fit_together_end_early(spark):
    rows = [(k, 0, 0, 1100 + k % 7, 0) for k in range(2000)]
    packed = packing.pack(spark.createDataFrame(rows, packing.PIECE), 2048, leaf_items=100, fan_in=4)
    assert packed.select("sequence_id").distinct().count() == 2000
    assert packing.pack(spark.createDataFrame([], packing.PIECE), 2048).count() == 0
