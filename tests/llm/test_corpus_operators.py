"""Operators that learn or join, and the pipeline."""

import importlib
import os
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from ondula.llm import common, exact_dedup, logistic, ngram_join, pii, site_quality, toxicity
from ondula.llm.common import written
from ondula.llm.components import components


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def linked(rows):
    """Components by comparing every pair that shares a shingle."""
    sets = [(i, shingles(t)) for i, t in rows]
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    where = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    for a, b in {(a, b) for ks in where.values() for j, a in enumerate(ks) for b in ks[j + 1 :]}:
        if 100 * len(sets[a][1] & sets[b][1]) >= 80 * len(sets[a][1] | sets[b][1]):
            top[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        low[find(k)] = min(low.get(find(k), i), i)
    return Counter((i, len(s), low[find(k)]) for k, (i, s) in enumerate(sets))


def chain(n, step, size=60):
    """Texts of which neighbours are near copies, and distant ones are not."""
    return [" ".join(f"w{k}" for k in range(i * step, i * step + size)) for i in range(n)]


def own(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def test_ngram_join(pairs, listed):
    assert own(ngram_join.near_duplicates(pairs)) == linked(listed)


@pytest.mark.parametrize("split,block", [(ngram_join.SPLIT, ngram_join.BLOCK), (5, 3)])
def test_ngram_join_of_chains(spark, split, block):
    """Chains of near copies, groups that share a common passage without being near, and long lists in every phase."""
    import random

    draw = random.Random(3)
    texts = chain(40, 4) + chain(30, 7, 66)
    common = "common words at the start of very many texts that are otherwise apart from each other"
    texts += [f"{common} {' '.join(str(draw.randrange(10**6)) for _ in range(draw.randrange(2, 30)))}" for _ in range(60)]
    base = [str(draw.randrange(1000)) for _ in range(80)]
    for _ in range(60):
        words = list(base)
        for _ in range(draw.randrange(5)):
            words[draw.randrange(80)] = "changed"
        texts.append(" ".join(words))
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    assert own(ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), split=split, block=block)) == linked(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {(r["id"], r["component"]) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(i, 0) for i in range(51)} | {(i, 100) for i in (100, 101, 102)}


def apart(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_small_tables_are_few_files(spark, monkeypatch):
    """Every file of a local disk starts a process of the executor, so tables of a few rows are not a file for each partition of their shuffle."""
    made, module = [], importlib.import_module("ondula.llm.components")
    monkeypatch.setattr(module, "written", lambda *a: made.append(common.written(*a)) or made[-1])
    monkeypatch.setattr(module, "release", lambda *tables: None)
    wide = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wide}
    for k, v in wide.items():
        spark.conf.set(k, v)
    try:
        got = module.components(spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 301 and {r["component"] for r in got} == {0}
    assert len(made) > 8 and {len(t.inputFiles()) for t in made[1:]} == {1}
    for t in made:
        common.release(t)


def test_small_tables_start_few_processes(spark, docs):
    """Tables of a few steps are Spark's blocks and leave none; filters are one file; no table has a success marker."""
    wide = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, blocks, seen = {k: spark.conf.get(k) for k in wide}, spark.sparkContext._jsc.getPersistentRDDs().size(), set(common._written)
    for k, v in wide.items():
        spark.conf.set(k, v)
    try:
        pii.sanitise(docs)
        made = [name.rsplit("/", 1)[1].rsplit("-", 1)[0] for name in common._written if name not in seen]
        assert made == ["pii-spans", "pii-known", "pii-places", "pii-terms", "pii-marks"]
        members = ngram_join._members(spark.range(300).select(F.col("id").alias("key")), exact_dedup.filter_bits(300_000))
        assert members.count() > 200 and len(members.inputFiles()) == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == blocks
    assert not Path(members.inputFiles()[0].removeprefix("file://")).with_name("_SUCCESS").exists()


def test_automaton():
    import random

    draw = random.Random(5)
    some = lambda k: "".join(draw.choice("abc") for _ in range(k))
    words = {some(draw.randrange(3, 9)): draw.random() for _ in range(60)}
    trie = toxicity.Trie(words)
    for _ in range(3000):
        word = some(draw.randrange(1, 10))
        near = [w for v, w in words.items() if v == word or len(v) >= toxicity.FUZZY_LENGTH and apart(v, word) <= 1]
        found = trie.find(word)
        want = (words[word], False) if word in words else (max(near), True) if near else None
        assert found == want, word


def test_toxicity(spark, data_dir):
    where = data_dir.replace("sf0.001", "sf0.01")
    rows = toxicity.op5(spark, where).collect()
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(label[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and label.get(r["doc_id"]) is not None]
    assert sum(y == p for y, p in held) / len(held) > 0.9
    toxic = [p for y, p in held if y == 1]
    print(f"held-out recall of toxic rows: {sum(toxic)} of {len(toxic)}")
    assert sum(toxic) >= 0.9 * len(toxic)


def test_toxicity_without_labels(spark, edge_docs, empty_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(edge_docs, toxicity.fit(edge_docs, none)).collect()} == {0.0}
    assert toxicity.score(empty_docs, toxicity.fit(empty_docs, none)).collect() == []


def test_edges_under_a_fitted_model(edge_docs, empty_docs):
    model = toxicity.Model({"passage": 3.0}, weights=[-2.0, 1.0, 1.0, -1.0, 0.5, 0.5, 0.1, 0.1, 1.0])
    assert toxicity.score(empty_docs, model).collect() == [] and toxicity.drop_toxic(empty_docs, model).collect() == []
    rows = toxicity.score(edge_docs, model).collect()
    texts = edge_docs.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in texts) and all(0 <= r["score"] <= 1 for r in rows)
    kept = toxicity.drop_toxic(edge_docs, model)
    assert kept.columns == edge_docs.columns
    assert Counter(r["text"] for r in kept.collect()) == Counter(r["text"] for r in texts if "passage" not in (r["text"] or ""))


def test_quoted_and_misspelled():
    hits = toxicity.worker_hits(toxicity.Model({"scoundrel": 3.0}, {"graus": 0.05}))
    names = toxicity.FEATURES
    read = lambda text: dict(zip(names, toxicity.features(text, hits)))
    assert read("you scoundrel!")["abuse"] == 1
    assert read("you scoundrell!")["misspelled"] == 1
    assert read('he wrote "you scoundrel" once')["quoted"] == 1
    assert read(None)["density"] == read("")["kinds"] == read("")["stems"] == 0
    few = toxicity.excess(2, 0.05 * 3)
    assert read("grausam, grausig! graben")["stems"] == min(few, 6) / 2 and read("grausam grausam graben")["stems"] < few / 2
    assert read("graben " + " ".join(f"gr{i}" for i in range(60)) + " grausam")["stems"] == 0  # one of 62 is no more than clean texts have


def test_stems_of_bent_words(spark):
    """A stem whose words are each too rare enters; roots that clean texts have as often do not, nor single texts that repeat one word."""
    endings = "am ig en er es lich heit bar los voll sam haft".split()
    clean = [(0, " ".join([f"gr{x}{i % 7}" for x in "aeiou"] + [f"bald{endings[i % 12]}", f"bald{endings[(i + 5) % 12]}", "und die", f"w{i}"])) for i in range(60)]
    toxic = [(1, f"graus{endings[i]} und graus{endings[i + 1]} graus{endings[i + 2]} bald{endings[i]} gra1 die t{i}") for i in range(6)]
    once = [(1, "krumm " * 9 + "krummes")]
    sample = spark.createDataFrame(clean + toxic + once, "y int, text string")
    found = toxicity.bent_stems(sample, {0: 60, 1: 7})
    assert list(found) == ["graus"] and found["graus"] == pytest.approx(0.5 / 301)


def test_weights_that_may_only_rise():
    draw = random.Random(8)
    rows = [[1.0, float(y), draw.random() - y, draw.random()] for y in (0, 1) * 60]
    free = logistic.fit(np.array(rows), np.array([0.0, 1.0] * 60))
    held = logistic.fit(np.array(rows), np.array([0.0, 1.0] * 60), rising=[False, True, True, False])
    assert free[2] < 0 and held[2] == 0 and held[1] > 0


def test_site_posteriors(spark):
    """Priors by plain sums: hosts spread around the global mean, paths around their hosts, every document without itself."""
    data = [("a", "x", 0.9)] * 40 + [("a", "y", 0.2)] * 3 + [("b", None, 0.1)] * 20 + [(None, "x", 0.5)]
    table, mean, k_host, k_path = site_quality.sites(spark.createDataFrame(data, "host string, path string, p double"))
    assert mean == pytest.approx(sum(d[2] for d in data) / len(data))

    def grouped(key):
        groups = {}
        for d in data:
            groups.setdefault(key(d), []).append(d[2])
        return groups

    hosts, paths = grouped(lambda d: d[0]), grouped(lambda d: d[:2])
    of = lambda g: sum(g) / len(g)
    strength = lambda groups, parent: max(1.0, mean * (1 - mean) / max(sum(len(g) * (of(g) - parent(k)) ** 2 for k, g in groups.items()) / len(data), 1e-9) - 1)
    assert k_host == pytest.approx(strength(hosts, lambda k: mean)) and k_path == pytest.approx(strength(paths, lambda k: of(hosts[k[0]])))
    assert {(r["host"], r["path"], r["n_path"], r["n_host"]) for r in table.collect()} == {(*k, len(g), len(hosts[k[0]])) for k, g in paths.items()}


def test_a_site_of_one_document_adds_nothing_of_its_own(spark):
    docs = spark.createDataFrame([(i, f"words of text {i} here", f"h{i}", "p") for i in range(4)], "doc_id long, text string, source string, lang string")
    for r in site_quality.classify(docs, None, F.col("source"), F.col("lang")).collect():
        assert r["path_posterior"] == pytest.approx(0.5) and r["score"] == pytest.approx(r["doc_probability"])


def test_site_quality(spark, data_dir):
    """Accuracy on labelled rows that the fit has not seen."""
    where = data_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    apart = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    weights = site_quality.fit(docs, labels.filter(~apart))
    rows = site_quality.classify(docs, weights, F.col("source"), F.col("lang")).join(labels.filter(apart & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id").collect()
    right = sum(r["quality"] == int(r["kept"]) for r in rows) / len(rows)
    print(f"held-out accuracy of site quality: {right:.3f} of {len(rows)}")
    assert right > 0.8


@pytest.mark.parametrize("work", [ngram_join.near_duplicates, ngram_join.drop_near_duplicates, lambda d: site_quality.classify(d, None, F.col("source"), F.col("lang"))])
def test_edges(work, edge_docs, empty_docs):
    assert work(empty_docs).collect() == []
    assert work(edge_docs).collect()


def test_pipeline(spark, data_dir):
    """Every stage against its rule on the stage's own input; run() gives the last stage's rows."""
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = written(stage(spark, docs, data_dir), "stage-test")
        rows = out.collect()
        if name != "packing":
            assert out.columns == names
            assert len({r["doc_id"] for r in rows}) == len(rows)
        after = {r["doc_id"] for r in rows}
        if name == "toxicity":
            assert 0.5 * len(before) < len(after) < len(before)
        elif name == "exact dedup":
            low = {}
            for i, r in before.items():
                key = re.sub("[\x20\x09-\x0d]+", " ", r["text"] or "")
                low[key] = min(low.get(key, i), i)
            assert after == set(low.values())
        elif name == "n-gram Jaccard join":
            assert after == {top for _, _, top in linked([(i, r["text"]) for i, r in before.items()])}
        elif name == "PII":
            assert after == set(before)
            assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r["text"] or "") for r in rows)
        else:
            assert after == set(before)
            assert len(rows) == corpus_pipeline.run(spark, data_dir).count()
        docs = out


@pytest.mark.parametrize("changed", [0, 3])
def test_toxicity_with_many_copies(spark, changed):
    """A third of all rows are copies or near copies of one toxic text: its words stay in the lexicon, and ordinary words stay out."""
    import random

    draw = random.Random(7)
    bad = ["scoundrel", "villain", "wretched", "rascal"]
    plain = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    rows = []
    for i in range(400):
        words = [draw.choice(plain) for _ in range(40)]
        if i % 4 == 0:
            words[draw.randrange(1, 40)], words[draw.randrange(1, 40)] = draw.choice(bad), draw.choice(bad)
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    hot = [draw.choice(plain) for _ in range(80)]
    hot[10::20] = bad
    for i in range(400, 600):
        words = list(hot)
        for _ in range(changed):
            words[20 * draw.randrange(4) + draw.randrange(9)] = draw.choice(plain)
        rows.append((i, " ".join(words), 1))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(table.drop("toxic"), table.drop("text"))
    assert set(model.lexicon) == set(bad)
    assert {(r["doc_id"], r["predicted"]) for r in toxicity.score(table, model).collect()} == {(i, y) for i, _, y in rows}


def test_stages_by_plain_versions(spark, data_dir):
    """Toxicity and PII stages against plain versions: the score by edit distances, and a masking of every kind with no other loss."""
    import math

    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{data_dir}/labels.parquet"))
    assert model.lexicon

    def hit(raw):
        word = re.sub(r"^\W+|\W+$", "", raw)
        if word in model.lexicon:
            return model.lexicon[word], False, word
        near = [v for w, v in model.lexicon.items() if len(w) >= toxicity.FUZZY_LENGTH and abs(len(w) - len(word)) <= 1 and apart(w, word) <= 1] if word else []
        return (max(near), True, word) if near else None

    hits = {}

    def toxic(text):
        words = (text or "").lower().split()
        for w in set(words) - hits.keys():
            hits[w] = hit(w)
        found = [(i, hits[w]) for i, w in enumerate(words) if hits[w]]
        kind = Counter()
        for i, (_, wrong, _) in found:
            left, right = words[max(0, i - 6) : i + 1], [x.rstrip(".,;:!?") for x in words[i : i + 7]]
            opened = any(x[0] in '"“«„‘' for x in left) and not any(x[-1] in '"”»“’' for x in left[:-1])
            kind["quoted" if opened and any(x and x[-1] in '"”»“’' for x in right) else "wrong" if wrong else "abuse"] += 1
        near = sum(b - a <= 6 for (a, _), (b, _) in zip(found, found[1:]))
        row = [1.0, *(min(kind[k], 6) for k in ("abuse", "wrong", "quoted")), min(len({h[2] for _, h in found}), 6), min(sum(h[0] for _, h in found), 40) / 10, math.log1p(1000 * len(found) / (len(words) + 20)), min(near, 6)]
        bare, nats = {re.sub(r"^\W+|\W+$", "", w) for w in words}, 0.0
        for stem, share in model.stems.items():
            n, expected = sum(w.startswith(stem) and w != stem for w in bare), share * sum(w[:2] == stem[:2] for w in bare)
            nats += n * math.log(n / expected) - (n - expected) if n > expected else 0
        row.append(min(nats, 6) / 2)
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(row, model.weights)))) >= 0.3

    listed = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = {r["doc_id"] for r in corpus_pipeline.toxicity_stage(spark, docs, data_dir).collect()}
    assert kept == {i for i, t in listed if not toxic(t)}

    from ondula.llm import pii

    spans = {r["doc_id"]: r["spans"] for r in pii.spans(docs).collect()}
    names = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}
    for r in corpus_pipeline.pii_stage(spark, docs, data_dir).collect():
        text, marks = dict(listed)[r["doc_id"]] or "", [(int(a), int(b), k) for k, a, b in (x.split(":") for x in spans[r["doc_id"]].split(",") if x)]
        out, at = "", 0
        for a, b, k in sorted(marks):
            if a >= at:
                out += re.escape(text[at:a]) + (names[k] if k in names else "(<TERM>)?")
            at = max(at, b)
        assert re.fullmatch(out + re.escape(text[at:]), r["text"] or ""), r["doc_id"]


def test_pipeline_of_empty_and_odd_tables(spark, edge_docs, empty_docs, tmp_path):
    """Whole runs over an empty table, and over one with nulls, copies, long texts and columns that clash."""
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for name, docs in (("empty", empty_docs), ("odd", edge_docs)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).collect() == []
    rows = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    texts = {r["doc_id"]: r["text"] for r in edge_docs.collect()}
    kept = {r["doc_id"] for r in rows}
    assert kept <= set(texts) and {i for i in kept if not (texts[i] or "").strip()} == {0, 2}
    assert {0, 2, 3, 6, 9, None} <= kept and not kept & {1, 4, 5, 7, 8}
    assert {r["doc_id"]: r["doc_tokens"] for r in rows}[0] == 1


def test_written_tables_are_plain_files(spark):
    """On a local disk Hadoop's checksummed files cost a process each to set their modes, which counts as a second copy of the JVM while it starts."""
    from ondula.llm.common import release, written

    table = written(spark.range(0, 100, 1, 5), "plain")
    names = os.listdir(table.written_at.removeprefix("file:"))
    assert len(names) == 5 and all(n.startswith("part-") for n in names)
    assert table.count() == 100
    release(table)
    assert not os.path.exists(table.written_at.removeprefix("file:"))
