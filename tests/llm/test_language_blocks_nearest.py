import random
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from ribospan.llm import blocks, language, nearest

# ---------------------------------------------------------------- language

SYLLABLES = {
    "en": ["the", "ing", "er", "ou", "th", "wh", "ed", "ly"], "fr": ["eau", "é", "que", "le", "oi", "eux", "ç", "ment"],
    "de": ["sch", "ung", "ü", "ein", "tz", "ö", "keit", "ber"], "es": ["ción", "ñ", "ll", "rr", "os", "ue", "ar", "mente"],
}


def prose(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def labelled(spark):
    rng, rows = random.Random(12), []
    for k in range(500):
        lang = rng.choice(list(SYLLABLES))
        rows.append((k, prose(rng, lang, rng.randint(2, 120)), lang if k % 11 else None, lang))
    odd = [(900, None, "en"), (901, "", "en"), (902, "123 ... ***", "fr"), (903, "ç", None), (None, rows[1][1], None)]
    df = spark.createDataFrame([r[:3] for r in rows] + odd + [rows[2][:3]] * 2, "doc_id long, text string, lang string")
    return df, {r[0]: r[3] for r in rows}


def test_held_out_accuracy_and_odd_rows(labelled):
    df, truth = labelled
    got = language.identify(df.withColumn("score", F.lit("clash"))).collect()
    assert len(got) == 507
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held) > 50
    assert {r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {"und"}


def test_only_text_decides(labelled):
    df, _ = labelled
    model = language.train(df, language.held_out_key())
    a = {r.doc_id: r.lang_pred for r in language.predict(df, model).collect()}
    b = {r.doc_id: r.lang_pred for r in language.predict(df.withColumn("lang", F.lit("xx")), model).collect()}
    assert a == b


def test_mixture_proportions(labelled):
    df, _ = labelled
    model = language.train(df, F.lit(False))
    rng = random.Random(1)
    mixed = prose(rng, "de", 140) + " " + prose(rng, "es", 60)
    lang, score = language.infer([mixed, prose(rng, "fr", 50)], model)
    names = [model["languages"][k] for k in lang]
    assert names == ["de", "fr"] and 0.6 < score[0] < 0.8 and score[1] > 0.95


def test_the_set_grows_as_far_as_the_text_asks(labelled):
    df, _ = labelled
    model = language.train(df, F.lit(False))
    rng, names = random.Random(4), model["languages"]
    even = " ".join(prose(rng, x, 60) for x in names)
    odd = "9 " * 20 + "zq xj qz jx " * 30
    sets, shares, fit = language.mixtures([even, prose(rng, "de", 80), odd, "1 2 3"], model)
    assert (sets[0] > 0.15).all() and abs(sets[0].sum() - 1) < 1e-6 and (sets[1] > 0).sum() == 1 and not sets[3].any()
    assert fit[2] < language.BLIND < fit[1] and fit[0] > language.BLIND
    found = language.predict(df.sparkSession.createDataFrame([(1, even), (2, None)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert sorted(found[0].languages) == sorted(names) and found[0].lang_pred == found[0].languages[0] and found[1].languages == []
    mixed = df.sparkSession.createDataFrame([(1, even, "en"), (2, odd, "en"), (3, "12", "de")], df.schema)
    assert 1 in {r.doc_id for r in language.keep_identified(df.unionByName(mixed)).where("text = '" + even + "'").collect()}


def test_the_model_takes_the_languages_with_the_most_rows(labelled):
    df, _ = labelled
    all_names = language.train(df, F.lit(False))["languages"]
    few = language.train(df, F.lit(False), most_languages=2)["languages"]
    counts = {r.lang: r["count"] for r in df.where("text is not null").groupBy("lang").count().collect() if r.lang}
    assert sorted(few) == sorted(sorted(counts, key=lambda x: (-counts[x], x))[:2]) and len(all_names) == 4


def test_em_against_one_document_at_a_time(labelled):
    df, _ = labelled
    model = language.train(df, F.lit(False))
    texts = [r.text for r in df.where("text is not null").limit(40).collect()]
    lang, score = language.infer(texts, model)
    for k, t in enumerate(texts):
        one, s = language.infer([t], model)
        assert one[0] == lang[k] and s[0] == pytest.approx(score[k])


def test_rejects_and_empty_tables(spark, labelled):
    df, _ = labelled
    kept = language.keep_identified(df)
    assert kept.columns == df.columns
    gone = {r.doc_id for r in df.collect()} - {r.doc_id for r in kept.collect()}
    assert {900, 901, 902} <= gone and len(gone) < 25
    empty = df.limit(0)
    assert language.identify(empty).count() == 0 and language.keep_identified(empty).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}


# ---------------------------------------------------------------- blocks

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><p>no";</script></head><body>
<header><h1>Site name and its long claim that says what this is all about today</h1></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site to make it better for you and for all of us here</div>
<article><h1>A &lt;title&gt;</h1><p><b>First   para&shy;graph with\n<a href=x>a link</a> &amp; more.<br><p>Short.
<ul><li>An item</li></ul><div class="ad">Buy this very good thing now and be happy with it for ever</div>
<aside>Related things that people like you have read on this site in the last few days</aside>
<p>Last one, said &quot;he&quot; &#8212; end.</p></article>
<section id="comments"><p>I think that this is a very good article that everybody should read at least once</p></section>
<form><label>Your mail</label><input name=a><button>Go</button></form>
<div class="sidebar"><p>Some words about us that stand at the side of each page of this site, long enough</p></div>
<footer>&copy; x &middot; Something about the publisher of this site and all of its rights</footer></body></html>"""


def test_the_article_and_nothing_else():
    text, _, _ = blocks.main_text(PAGE, blocks.train())
    assert text == "A <title>\nFirst para­graph with a link & more.\nShort.\nAn item\nLast one, said \"he\" — end."


def test_pages_without_article_go_by_words_and_links():
    long = "word " * 40
    page = f"<body><div><a href=a>x y</a> <a href=b>z</a></div><p>{long}</p><p>A small heading</p><p>{long}</p><p><a href=c>more of this</a></p></body>"
    assert blocks.main_text(page, blocks.train())[0] == "\n".join([long.strip(), "A small heading", long.strip()])


def test_cut_off_pages_and_odd_rows(spark):
    rows = [(1, "u", "<article><p>cut off &amp"), (2, None, None), (3, "u", ""), (None, "u", "<article><p>a < b <em"), (1, "u", "<article><p>cut off &amp"),
            (4, "u", "<article>" + "<p>many words here" * 40000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in blocks.extract(df).collect())
    assert got[0] == (0, "a < b", 5) and got[1] == got[2] == (1, "cut off &", 9) and got[3][1] == got[4][1] == ""
    assert got[5][1].count("\n") == 39999
    assert blocks.extract(df.limit(0)).count() == 0


def test_the_tree_learns_its_table():
    tree = blocks.train()
    assert all(blocks.decide(tree, x) == bool(y) for x, y in blocks.LABELLED)
    assert len(blocks.LABELLED) <= 200


@pytest.mark.parametrize("begin", [
    '<div class="layout has-sidebar"><article>', '<div id="page" class="no-sidebar with-comments"><article>',
    '<section class="content share-enabled">', '<div class="page sidebar"><main>', '<form id=f><article title="the hidden city">',
    '<div class="content" title="the hidden city">',
])
def test_words_of_the_layout_do_not_lose_the_article(begin):
    body = "<p>" + "word " * 40 + "<p>A short one.<p>" + "more " * 30
    text = blocks.main_text(begin + body, blocks.train())[0]
    assert text == "\n".join([("word " * 40).strip(), "A short one.", ("more " * 30).strip()])


@pytest.mark.parametrize("begin, end", [
    ('<section class="comments">', "</section>"), ('<div id="comments"><article>', "</article></div>"), ('<ol class="commentlist"><li>', "</li></ol>"),
    ("<footer>", "</footer>"), ('<div class="cookie-notice">', "</div>"), ('<div class="widget">', "</div>"), ("<form>", "</form>"),
    ('<aside><article class="post">', "</article></aside>"), ('<section class="comment-list"><article class="comment">', "</article></section>"),
    ('<div class="related-posts"><article>', "</article></div>"), ('<div class="usercomments"><div class="content">', "</div></div>"),
    ("<div hidden>", "</div>"), ('<nav class="content">', "</nav>"),
])
def test_marks_hold_for_text_of_any_length(begin, end):
    own = "<article>" + "".join(f"<p>{'article ' * 60}" for _ in range(3)) + "</article>"
    for words in (4, 60, 150, 200, 1000):
        beside = begin + "".join(f"<p>{'aside ' * words}" for _ in range(4)) + end
        for page in (own + beside, beside + own, f"<body>{beside}<div class=main>{own}</div></body>"):
            text = blocks.main_text(page, blocks.train())[0]
            assert "aside" not in text and text.count("article") == 180, (words, page[:60])


class _Walk(HTMLParser):
    """A second extractor: text under elements that a test labels by an attribute."""

    def __init__(self):
        super().__init__()
        self.stack, self.out, self.now = [], [], []

    def handle_starttag(self, tag, attrs):
        keep = dict(attrs).get("data-label")
        self.flush()
        self.stack.append(keep if keep else self.stack[-1] if self.stack else "other")

    def handle_endtag(self, tag):
        self.flush()
        self.stack.pop()

    def handle_data(self, data):
        self.now.append(data)

    def flush(self):
        text = " ".join("".join(self.now).split())
        if text and self.stack and self.stack[-1] == "main":
            self.out.append(text)
        self.now = []


def labelled_page(rng):
    prose = lambda n: " ".join(rng.choice(["river", "stone", "light", "is", "the", "over", "&amp;", "caf&eacute;"]) for _ in range(n))
    p = lambda n: f"<p>{prose(n)}</p>"
    beside = [
        lambda: "<nav><ul>" + "".join(f'<li><a href="/{k}">{prose(2)}</a></li>' for k in range(5)) + "</ul></nav>",
        lambda: f'<div class="{rng.choice(["cookie-banner", "newsletter", "ad-slot", "share-buttons", "breadcrumbs"])}">{p(rng.randint(3, 220))}</div>',
        lambda: f'<section id="{rng.choice(["comments", "respond", "disqus_thread"])}"><div>{p(rng.randint(3, 220))}</div>{p(150)}</section>',
        lambda: f"<footer>{p(rng.randint(3, 200))}</footer>",
        lambda: f"<form><p>{prose(rng.randint(2, 90))}</p></form>",
        lambda: f'<aside class="sidebar"><h3>{prose(3)}</h3>{p(rng.randint(5, 160))}</aside>',
    ]
    article = f"<h1>{prose(6)}</h1>" + "".join(rng.choice([p(rng.randint(5, 120)), f"<h2>{prose(3)}</h2>{p(80)}", f"<ul><li>{prose(7)}</li><li>{prose(9)}</li></ul>"]) for _ in range(rng.randint(2, 7)))
    before, after = ("".join(f() for f in rng.sample(beside, rng.randint(0, 3))) for _ in range(2))
    return f'<html><body data-label="other">{before}<article data-label="main">{article}</article>{after}</body></html>'


def test_pages_with_labelled_blocks_against_a_second_extractor():
    rng, tree = random.Random(12), blocks.train()
    for _ in range(150):
        page = labelled_page(rng)
        walk = _Walk()
        walk.feed(page)
        assert blocks.main_text(page, tree)[0] == "\n".join(walk.out)


# ---------------------------------------------------------------- nearest

def vectors(n, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, 16))
    x = centers[rng.integers(0, 5, n)] + rng.normal(size=(n, 16))
    x[:, 0] *= 2
    return x


def by_force(rows, k, every):
    good = {i: np.array(v) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    out = {}
    for q in good:
        if q % every == 0:
            scored = sorted(((-float(np.dot(good[q], good[i])), i) for i in good if i != q))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_recall_and_exact_measure(spark):
    x = vectors(3000)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=256).collect()
    want, found = by_force(rows, 20, 20), {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(found) == set(want)
    hits = 0
    for q, ranks in found.items():
        assert sorted(ranks) == list(range(1, len(ranks) + 1))
        listed = [ranks[k] for k in sorted(ranks)]
        assert listed == sorted(listed, key=lambda a: (-a[1], a[0]))
        assert all(s == pytest.approx(float(np.dot(x[q], x[i])), rel=1e-12) for i, s in listed)
        hits += len({i for i, _ in listed} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_copies_ties_and_unusable_vectors(spark):
    same = [1.0, 2.0, 0.5]
    rows = [(k, same) for k in range(60)] + [(100 + k, [float(k), 1.0, -1.0]) for k in range(10)]
    odd = [(200, None), (220, [0.0, 0.0, 0.0]), (240, [1.0, None, 1.0]), (260, [float("nan"), 1.0, 1.0]), (280, [float("inf"), 1.0, 1.0]), (None, same), (0, same)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {}
    for r in nearest.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = by_force(rows, 20, 20)
    assert set(got) == set(want) == {0, 20, 40, 100}
    for q in (0, 20, 40):
        assert got[q] == [i for i, _ in want[q]]
    few = nearest.search(spark.createDataFrame(rows[:3], df.select("vec_id", "embedding").schema)).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(few, key=lambda r: r.rank)] == [(0, 1, 1), (0, 2, 2)]
    assert nearest.search(df.limit(0)).count() == 0


def test_outlier_norms_and_scattered_tables_give_all_wanted(spark):
    rng = np.random.default_rng(5)
    far = vectors(2000)
    far[7] *= 1e6
    far[1000:] *= 1e-3
    for x, k in ((far, 20), (rng.normal(size=(60, 40)), 20), (rng.normal(size=(9, 40)), 8)):
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        want, got = by_force(rows, 20, 20), {}
        for r in nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=512).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert set(got) == set(want) and all(len(got[q]) == k for q in want)
        assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) >= 0.9 * k * len(want)


def test_ties_at_the_border_go_to_the_smaller_ids(spark):
    """All points are in one bucket's reach here, so the answer is exact: many equal scores, of which the smallest ids stay."""
    rng = np.random.default_rng(9)
    rows = [(int(i), v) for i, v in zip(rng.permutation(1500), (rng.random((1500, 6)) < 0.5).astype(float).tolist(), strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, got = by_force(rows, 20, 20), {}
    for r in nearest.search(df, probes=343, block=400).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(want)
    hits = sum(got[q] == [i for i, _ in want[q]] for q in want)
    assert hits >= 0.9 * len(want)


def test_best_of_keeps_ties_in_order_of_id():
    rng = np.random.default_rng(2)
    asked, stored = rng.integers(0, 2, (30, 12)).astype(float), rng.integers(0, 2, (800, 12)).astype(float)
    first = rng.permutation(800)
    row, column, score = nearest.best_of(asked, stored, first, np.full(30, -np.inf), 21)
    for q in range(30):
        exact = sorted((-float(asked[q] @ stored[i]), first[i]) for i in range(800))[:21]
        assert [(-s, first[c]) for c, s in zip(column[row == q], score[row == q], strict=True)] == exact


def test_each_length_is_an_index_of_its_own(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5 if i % 3 else 8).tolist()) for i in range(300)] + [(1000, [1.0, 2.0])]
    found = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), probes=200).collect()
    size = {i: len(v) for i, v in rows}
    got = {}
    for r in found:
        assert size[r.query_id] == size[r.vec_id]
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(len(got[q]) == 20 for q in range(0, 300, 20)) and 1000 not in got
