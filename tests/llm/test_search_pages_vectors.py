"""Whitening, ranked search and HTML extraction against plain versions of their rules."""

import html
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ondula.llm import html_extract, search, whitening
from tests.llm.conftest import EDGE_TEXTS

# search


def plain_search(docs, items, k=50):
    """Rows of (item_id, rank, doc_id, score) by scoring every document."""
    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    held = [(i, split(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df = {}
    for _, words in held:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    rows = []
    for item, text in items:
        found = []
        for i, words in held:
            total = 0
            for t in set(split(text)) & set(words):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 50 + (50 * len(words) * n_docs) // n_terms
                total += weight * ((1000000000 * words.count(t)) // (1000 * words.count(t) + 20 * m))
            if total > 0:
                found.append((-total, i is None, i or 0, i))
        rows += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(rows, key=str)


def rows_of(df, *names):
    return sorted(([tuple(r[n] for n in names) for r in df.collect()]), key=str)


@pytest.mark.parametrize("shard", [3, 8192])
def test_search_against_plain_scores(spark, docs, edge_docs, data_dir, monkeypatch, shard):
    monkeypatch.setattr(search, "SHARD", shard)
    both = docs.select("doc_id", "text").unionByName(edge_docs.select("doc_id", "text"))
    items = [(1, "word7 and number"), (2, None), (3, ""), (4, "The THE of, documents and"), (4, "the passage stands"), (None, "İstanbul café 中文"), (6, "!!!"), (7, "a b c d e f g h in on is as re")]
    items += [(100 + r["item_id"], r["text"]) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()[:12]]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("terms", F.lit("x"))
    got = search.search(both, asked)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    want = plain_search([(r["doc_id"], r["text"]) for r in both.collect()], items)
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == want


def test_search_in_blocks_of_items(spark, docs, data_dir, monkeypatch):
    items = spark.read.parquet(f"{data_dir}/benchmark.parquet")
    whole = rows_of(search.search(docs, items, k=7), "item_id", "rank", "doc_id", "score")
    monkeypatch.setattr(search, "BLOCK_TERMS", 400)
    assert rows_of(search.search(docs, items, k=7), "item_id", "rank", "doc_id", "score") == whole


def test_search_of_nothing(spark, docs, empty_docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert search.search(docs, nothing).count() == 0
    assert search.search(empty_docs, nothing.union(spark.createDataFrame([(1, "the")], nothing.schema))).count() == 0


def test_shard_stops_early_and_keeps_all_that_may_win():
    """High impacts settle the best documents before the long list of a common term is read; random shards agree with whole scores."""
    docs = np.concatenate([np.arange(10), np.arange(10), np.arange(5000)])
    term = np.concatenate([np.zeros(10, int), np.ones(10, int), np.full(5000, 2)])
    impact = np.concatenate([np.full(10, 90000), np.full(10, 80000), np.full(5000, 10)])
    found, score, read = search.Shard(docs, term, impact, 5000, 3).best(np.array([0, 1, 2]), 10, 0)
    assert sorted(found) == list(range(10)) and set(score) == {170010} and read == 20
    assert len(search.Shard(docs, term, impact, 5000, 3).best(np.array([2]), 10, 11)[0]) == 0
    rng = np.random.default_rng(5)
    for _ in range(200):
        size, n_terms, k = int(rng.integers(1, 60)), int(rng.integers(1, 8)), int(rng.integers(1, 6))
        held = rng.random((size, n_terms)) < 0.4
        values = rng.integers(1, 10 ** int(rng.integers(1, 6)), (size, n_terms)) * held
        docs, term = np.nonzero(held)
        whole = values.sum(1)
        found, score, _ = search.Shard(docs, term, values[docs, term], size, n_terms).best(np.arange(n_terms), k, 0)
        assert (whole[found] == score).all()
        least = np.sort(whole)[-min(k, size)]
        assert {i for i in range(size) if whole[i] >= max(least, 1)} <= set(found.tolist())


# whitening


def vectors(spark, n=300, d=10, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 0.2
    base[:, 0] = base[:, 1]  # a dimension that depends on another
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(base)] + [(5, [float(np.float32(v)) for v in base[5]])] * 2
    odd = [(900, None), (901, [None] * d), (902, [math.nan] * d), (903, [math.inf] + [0.0] * (d - 1)), (None, [0.5] * d)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("x", F.lit(1)).withColumn("place", F.lit(2)), [*rows, odd[-1]]


@pytest.mark.parametrize("n,d", [(300, 10), (6, 10), (400, 130)])
def test_whitening_against_numpy(spark, n, d):
    df, rows = vectors(spark, n, d)
    got = whitening.whiten(df).collect()
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for _, v in rows], dtype=np.int64)
    count, sums = len(x), x.sum(0)
    centred = x - sums / count
    covariance = centred.T @ centred / count
    values = np.sort(np.linalg.eigvalsh(covariance))[::-1]
    rank = min(32, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == count * rank and {r["n"] for r in got} == {count}
    deviation = sorted(int(v) for v in ((count * x - sums) ** 2).sum(1))
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == deviation
    by = {}
    for r in got:
        by.setdefault((r["component"], r["vec_id"]), []).append(r)
    for c in range(1, rank + 1):
        e = values[c - 1]
        some = by[c, 0][0]
        assert some["explained"] == pytest.approx(e / np.trace(covariance), rel=1e-9)
        z = np.array([r["whitened"] for r in got if r["component"] == c])
        assert abs(z.mean()) < 1e-7 and z.var() == pytest.approx(1, abs=1e-6)
    axes = np.linalg.eigh(covariance)[1][:, ::-1]
    for c in range(1, min(rank, 4) + 1):
        want = centred[0] @ axes[:, c - 1] / math.sqrt(values[c - 1])
        assert abs(by[c, 0][0]["whitened"]) == pytest.approx(abs(want), abs=1e-6)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-4
    assert len(by[1, 5]) == 3 and len({r["whitened"] for r in by[1, 5]}) == 1 and len(by[1, None]) == 1


def test_whitening_without_variance(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])] * 3, kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], kind)).count() == 0
    with pytest.raises(Exception, match="unequal"):
        whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5])], kind)).count()


def test_whitening_of_the_table(spark, data_dir):
    df = whitening.op11(spark, data_dir)
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = df.agg(F.count("*"), F.max("identity_error"), F.sum(F.when(F.col("vec_id") == 0, F.col("explained")))).first()
    assert got[0] == 500 * 32 and got[1] < 1e-10 and 0.4 < got[2] < 1


# HTML


@pytest.fixture(scope="module")
def model(spark, data_dir):
    return html_extract.fit(spark.read.parquet(f"{data_dir}/pages.parquet"))


def article_of(source):
    """The marked article's blocks, for the simple pages of the table."""
    blocks = re.split(r"</?p>|</?h1>", re.search(r"<article>(.*?)</article>", source, re.S)[1])
    blocks = [" ".join(html.unescape(re.sub(r"<br>|</?b>", " ", b)).split()) for b in blocks]
    return "\n\n".join(b for b in blocks if b)


def test_articles_of_the_table(spark, data_dir):
    where = data_dir.replace("sf0.001", "sf0.01")
    want = {r["page_id"]: article_of(r["html"]) for r in spark.read.parquet(f"{where}/pages.parquet").collect()}
    got = html_extract.op13(spark, where)
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    assert {r["page_id"]: r["text"] for r in got.collect()} == want


WRAPPERS = [("<article>", "</article>"), ("<main>", "</main>"), ("<div id='content'>", "</div>"), ("<div class='x17'>", "</div>"), ("<main><article class='post'>", "</article></main>"), ("<div class='row'><div class='col-8'>", "</div></div>"), ("", "")]
BEFORE = ["<nav><a href='/'>Home</a> <a href='/b'>About us</a></nav>", "<div class='menu'><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></div>", "<header><h1>Site</h1><p>The best site there is</p></header>", "<div id='cookie-notice'><p>We use cookies, please accept them all now.</p></div>"]
AFTER = ["<footer><p>Copyright by us all rights reserved</p></footer>", "<aside class='sidebar'><h3>Popular</h3><ul><li><a href=z>Another thing</a></ul></aside>", "<section class='comments'><div class='comment'><p>" + "rave " * 90 + "</p></div></section>", "<div id='comments'><article class='comment'><p>" + "rant " * 80 + "</p></article></div>", "<form action='/s'><label>Sign up</label><input></form>"]
MIDDLE = ["", "<div class='ad'>Buy this great product now for less</div>", "<aside>Read also this other text</aside>", "<form><p>Subscribe to our letter</p><button>Go</button></form>", "<div class='share-buttons'><a href=1>Tweet</a></div>", "<script>var x='<p>no</p>'</script>", "<!-- <p>no</p> -->", "<style>p{}"]


def test_unseen_layouts(model):
    body = "<h1>Title &amp; more</h1><p>" + "lorem  ipsum\n" * 20 + "</p><p>one</p>{}<h2>Part</h2><p>a<br>b <a href=k>link</a> c<ul><li>one item<li>two</ul><p>end"
    want = "Title & more\n\n" + " ".join(["lorem ipsum"] * 20) + "\n\none\n\nPart\n\na b link c\n\none item\n\ntwo\n\nend"
    for (a, z), before, after, middle in itertools.product(WRAPPERS, BEFORE, AFTER, MIDDLE[:-1]):
        assert html_extract.extract(f"<html><head><title>t</title></head><body>{before}{a}{body.format(middle)}{z}{after}</body></html>", model) == want, (a, before, after, middle)


def test_odd_pages(spark, model):
    cases = {
        None: "", "": "", " \n ": "", "plain text &lt; more": "plain text < more", "<nav><a>x</a></nav>": "", "<p>open <b>bold<p>next": "open bold\n\nnext",
        "<article><p>a &amp b &#x41;&nbsp;c</p></article>": "a & b A c", "<p>one < two</p>": "one < two", "<p>x</p><script>never closed <p>y": "x", "<p>x</p><!-- never closed <p>y": "x",
        "</div></p><p title=\"a>b\">x y z</p>": "x y z", "<p>" + "word " * 60000 + "</p>": " ".join(["word"] * 60000), "<P CLASS=Intro>Up</P>": "Up", "<p>a</p><![CDATA[<b>]]>": "a\n\n<b>",
    }
    rows = [(i, f"u{i}", page) for i, page in enumerate(cases)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in html_extract.extract_text(df.union(df), model).collect()}
    for (i, _, page), want in zip(rows, cases.values(), strict=True):
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want), page
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract_text(none, html_extract.fit(none)).count() == 0


def test_region_is_the_best_of_all():
    rng = random.Random(zlib.crc32(b"regions"))
    for _ in range(300):
        scores = [rng.choice([-3.0, -1.0, -0.5, 0.5, 1.0, 2.0]) for _ in range(rng.randint(0, 12))]
        a, b = html_extract.best_region(scores)
        every = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        assert sum(scores[a:b]) == max([0.0, *every])


def test_search_edge_texts_are_whole():
    assert search.terms(EDGE_TEXTS[6].encode())[-1] == b"8999" and search.terms("İ K Ä_a".encode()) == ["İ".encode(), b"k", "Ä".encode(), b"a"]
