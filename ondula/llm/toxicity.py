"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, and context windows around the hits.

Learning. From labelled texts each word gets the log-odds of occurring in a toxic rather than a clean text. Words enter the lexicon when the
odds are high enough and they follow enough different words; how many are enough does not depend on the number of texts. Where a language bends one stem into many words,
each is too rare for that; so a node of the trie of all words may enter as a stem. Its words are counted among those that share its first ROOT letters, which
makes texts of other languages neutral without knowing any language: by the clean texts' share a text with m words of the root is expected to have a Poisson number of the
stem's, and a stem enters when toxic texts exceed that together by STEM_EVIDENCE nats more than clean ones do. Texts of the training sample then
get features, and a logistic regression weighs them; what counts hits outside quotations cannot lower a score. The sample has at most `train_rows` rows, chosen by a hash of their ids. Copies and near copies of a text
with its label count once in it, for the lexicon and for the weights: MinHash signatures of word shingles go to the driver (a few MB at most), and a text whose
signature agrees with that of an earlier one in NEAR_COPY of its places goes.

Scoring. The lexicon is a trie. For a word the automaton of all strings within one edit is run along the trie as bit sets, branches without a live state
are cut, and a final state at a word end is a hit, exact or misspelled. Short lexicon words match exactly only. Each hit is judged by the words around it:
inside quotation marks it counts as quoted, otherwise as abuse. Different words of a stem beyond what is expected count by the same nats. One scan of the texts, no
shuffle; lexicon, stems and weights are closed over, and are bounded by what `train_rows` texts hold. Counts are cut off at a few hits, which scales the features only.

Defined cases: null and empty texts have no hits and get the score of a clean text. Equal texts get equal scores. Repeated labels of an id count once
for each value; null labels are ignored. Without labels of both kinds every score is 0. Very long texts are scored whole. An empty table gives no rows. Columns of docs other than
id and text are never read for a score, and are kept by `drop_toxic`.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ondula.llm import logistic
from ondula.llm.common import arrow_map, documents, keep, slices, text_of, written

TRAIN_ROWS = 20_000
MIN_LOG_ODDS = 2.0
#: Standard errors that are taken off the log-odds first.
MARGIN = 1.64
#: A lexicon word follows this many different words at least.
MIN_CONTEXTS = 4
#: Places of a signature, words of a shingle, and the part of the places in which near copies agree.
SIGNATURE = 32
SHINGLE = 5
NEAR_COPY = 0.4
#: Shorter lexicon words match exactly only.
FUZZY_LENGTH = 5
WINDOW = 6
THRESHOLD = 0.3
CACHE_WORDS = 200_000
_EDGES = re.compile(r"^\W+|\W+$")
_OPEN, _CLOSE = "\"“«„‘", "\"”»“’"
FEATURES = ("one", "abuse", "misspelled", "quoted", "kinds", "weight", "density", "near", "stems")
#: Letters of a root, and of a stem at least and at most.
ROOT, STEM_LEAST, STEM_MOST = 2, 4, 8
#: Nats by which toxic texts exceed the expected words of a stem, of which one text gives at most MOST_NATS; two texts at least have two words of it.
STEM_EVIDENCE, MOST_NATS, STEM_TEXTS = 12.0, 8.0, 2
#: Log-odds of a text with a word of the stem being toxic.
STEM_ODDS = 1.5


class Trie:
    """Lexicon words; `find` intersects it with the automaton of strings within one edit of a word."""

    def __init__(self, words: dict[str, float], fuzzy_length: int = FUZZY_LENGTH) -> None:
        self.root: dict = {}
        self.words = words
        self.heads: dict[str, set[int]] = {}
        self.tails: dict[str, set[int]] = {}
        for word in words:
            if len(word) < fuzzy_length:
                continue
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = word
            half, near = len(word) // 2, {len(word) - 1, len(word), len(word) + 1}
            self.heads.setdefault(word[:half], set()).update(near)
            self.tails.setdefault(word[half:], set()).update(near)
        self.head_sizes = sorted({len(x) for x in self.heads})
        self.tail_sizes = sorted({len(x) for x in self.tails})

    def possible(self, word: str) -> bool:
        """One edit leaves the first or the second half of a lexicon word whole, and its length within one."""
        n = len(word)
        for k in self.head_sizes:
            if (lengths := self.heads.get(word[:k])) and n in lengths:
                return True
        for k in self.tail_sizes:
            if (lengths := self.tails.get(word[-k:])) and n in lengths:
                return True
        return False

    def find(self, word: str) -> tuple[float, bool] | None:
        """(weight, misspelled) of the word's best hit: itself, else the heaviest lexicon word within one edit."""
        if word in self.words:
            return self.words[word], False
        if not self.possible(word):
            return None
        last = 1 << len(word)
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        best = None
        stack = [(self.root, 1, 3)]  # node, positions reached without an edit, with one (dropping a letter of the word costs one)
        while stack:
            node, exact, edited = stack.pop()
            for c, child in node.items():
                if c == "":
                    if (exact | edited) & last and (best is None or self.words[child] > best):
                        best = self.words[child]
                    continue
                same = masks.get(c, 0)
                on = (exact & same) << 1
                off = (edited & same) << 1 | exact << 1 | exact | on << 1
                if on | off:
                    stack.append((child, on, off))
        return None if best is None else (best, True)


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)  # the share of the root's words that they have in clean texts
    weights: list[float] | None = None


class _Hits(dict):
    """Raw word -> hit or None."""

    def __init__(self, trie: Trie, stems: dict[str, float]) -> None:
        super().__init__()
        self.trie, self.stems = trie, stems
        self.roots = {s[:ROOT] for s in stems}
        self.bent: dict[str, tuple[str, str | None] | None] = {}  # raw word -> word and stem, where its root has stems

    def __missing__(self, raw: str):
        word = _EDGES.sub("", raw)
        self[raw] = found = (*hit, word) if word and (hit := self.trie.find(word)) else None
        return found

    def clear(self) -> None:
        super().clear()
        self.bent.clear()

    def nats(self, words: list[str]) -> float:
        """By how much the different words of stems exceed what their roots' words let expect."""
        if not self.stems:
            return 0.0
        seen = set()
        for raw in set(words):
            if raw not in self.bent:
                word = _EDGES.sub("", raw)
                stem = next((word[:n] for n in range(STEM_LEAST, min(STEM_MOST + 1, len(word))) if word[:n] in self.stems), None)
                self.bent[raw] = (word, stem) if word[:ROOT] in self.roots else None
            seen.add(self.bent[raw])
        seen.discard(None)
        roots = Counter(word[:ROOT] for word, _ in seen)
        return sum(excess(n, self.stems[stem] * roots[stem[:ROOT]]) for stem, n in Counter(stem for _, stem in seen if stem).items())


def excess(n: int, expected: float) -> float:
    """Log-likelihood of n over the expected number."""
    return n * math.log(n / expected) - (n - expected) if n > expected else 0.0


def worker_hits(model: Model) -> _Hits:
    """This worker's hits under a model."""
    return keep(("hits", frozenset(model.lexicon.items()), frozenset(model.stems.items())), lambda: _Hits(Trie(model.lexicon), model.stems))


def features(text: str | None, hits: _Hits) -> tuple[float, ...]:
    words = (text or "").lower().split()
    found = [(i, h) for i, h in enumerate(map(hits.__getitem__, words)) if h]
    abuse = wrong = quoted = near = 0
    weight, kinds, before = 0.0, set(), -(10**9)
    for i, (w, misspelled, word) in found:
        left, right = words[max(0, i - WINDOW) : i + 1], words[i : i + WINDOW + 1]
        opened = any(x[0] in _OPEN for x in left) and not any(x[-1] in _CLOSE for x in left[:-1])
        if opened and any(x.rstrip(".,;:!?")[-1:] in _CLOSE for x in right if x.rstrip(".,;:!?")):
            quoted += 1
        elif misspelled:
            wrong += 1
        else:
            abuse += 1
        weight += w
        kinds.add(word)
        near += i - before <= WINDOW
        before = i
    cap = 6
    return 1.0, min(abuse, cap), min(wrong, cap), min(quoted, cap), min(len(kinds), cap), min(weight, 40.0) / 10, float(np.log1p(1000 * len(found) / (len(words) + 20))), min(near, cap), min(hits.nats(words), cap) / 2


def _measure(model: Model):
    """Features of each row, or the score when the model has weights."""
    weights = model.weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = worker_hits(model)
        for batch in slices(batches):
            if len(hits) > CACHE_WORDS:
                hits.clear()
            rows = np.array([features(t, hits) for t in batch.column("text").to_pylist()])
            rest = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            if weights is None:
                yield pa.RecordBatch.from_arrays([*rest, pa.array(rows.tolist(), pa.list_(pa.float64()))], [*names, "features"])
            else:
                yield pa.RecordBatch.from_arrays([*rest, pa.array(logistic.sigmoid(rows @ np.array(weights))), pa.array((rows[:, 1] + rows[:, 2]).astype(np.int64))], [*names, "score", "n_hits"])

    return work


def signature(text: str | None) -> bytes:
    """MinHash of the text's shingles; a text of fewer words is one shingle."""
    words = (text or "").lower().split()
    codes = np.array([zlib.crc32(w.encode()) for w in words] or [0], np.uint64)
    n = min(SHINGLE, len(codes))
    mixed = np.zeros(len(codes) - n + 1, np.uint64)
    for i in range(n):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(mixed)]
    out = np.empty(SIGNATURE, np.uint64)
    for i in range(SIGNATURE):
        x = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9 + 2 * i * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
        out[i] = (x ^ x >> np.uint64(29)).min()
    return out.tobytes()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        signs = pa.array([signature(t) for t in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("copies"), signs], ["y", "copies", "sign"])


def leaders(rows: list[tuple[int, int, bytes]]) -> list[tuple[int, int]]:
    """(y, copies) of the rows (y, copies, signature) that are not near copies of an earlier leader of their label."""
    seen: dict[tuple, list[int]] = {}
    out = []
    for y, copies, sign in sorted(rows):
        places = [(y, i, sign[8 * i : 8 * i + 8]) for i in range(SIGNATURE)]
        agree = Counter(k for place in places for k in seen.get(place, ()))
        if agree and max(agree.values()) >= NEAR_COPY * SIGNATURE:
            continue
        for place in places:
            seen.setdefault(place, []).append(len(out))
        out.append((y, copies))
    return out


def held_out(column="doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> Model:
    """Learns lexicon and weights from the labelled rows that are not held out."""
    usable = labels.filter(~held_out(id_col) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    usable = usable.groupBy("id").agg(F.max("y").alias("y"))  # an id that labels repeat counts once
    total = usable.count()
    if not total:
        return Model()
    share = min(1.0, train_rows / total)
    chosen = usable.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    drawn = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "id")  # at most about train_rows ids
    # features see lower words only: texts that have the same are copies
    copies = F.xxhash64(F.split(F.trim(F.lower("text")), r"\s+"))
    distinct = written(drawn.groupBy("y", copies.alias("copies")).agg(F.min("text").alias("text")), "tox-sample")
    signs = arrow_map(distinct.select("y", "copies", "text"), _sign, "y int, copies long, sign binary").collect()
    first = docs.sparkSession.createDataFrame(leaders([(r["y"], r["copies"], bytes(r["sign"])) for r in signs]), "y int, copies long")
    sample = written(distinct.join(F.broadcast(first), ["y", "copies"]).select("y", "text"), "tox-leaders")
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if set(sizes) != {0, 1}:
        return Model()
    raw = F.split(F.lower("text"), r"[\s\p{Punct}“”«»„‘’]+")
    words = sample.select("y", raw.alias("w"))
    # a pair is one string, "before word": array_distinct hashes strings, but compares structs each with each
    met = F.zip_with("w", F.concat(F.array(F.lit("")), F.col("w")), lambda word, before: F.concat(before, F.lit(" "), word))
    pairs = words.select("y", F.explode(F.array_distinct(met)).alias("pair"))
    pairs = pairs.select("y", F.struct(F.substring_index("pair", " ", -1).alias("word"), F.substring_index("pair", " ", 1).alias("before")).alias("p"))
    by_doc = pairs.filter("p.word <> ''").groupBy("p.word").agg(
        F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"), F.approx_count_distinct(F.when(F.col("y") == 1, F.col("p.before")), 0.1).alias("contexts")
    )
    odds = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1)) - F.log((F.col("clean") + 0.5) / (sizes[0] + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    kept = by_doc.filter(F.col("contexts") >= MIN_CONTEXTS).withColumn("odds", odds).filter(F.col("odds") - MARGIN * error >= MIN_LOG_ODDS)
    lexicon = {r["word"]: float(r["odds"]) for r in kept.select("word", "odds").collect()}  # words of the bounded sample
    stems = bent_stems(sample, sizes)
    model = Model({w: o for w, o in lexicon.items() if not w.startswith(tuple(stems))}, stems)  # a stem counts its words by itself
    if not model.lexicon and not model.stems:
        return Model()
    rows = arrow_map(sample.select("y", "text"), _measure(model), "y int, features array<double>").collect()  # at most about train_rows rows of nine numbers
    rising = [f not in ("one", "quoted") for f in FEATURES]
    weights = logistic.fit(np.array([r["features"] for r in rows]), np.array([float(r["y"]) for r in rows]), rising=rising)
    return replace(model, weights=weights.tolist())


def _branches(text: str | None) -> tuple[Counter, Counter]:
    """The text's different words by root, and by every node of STEM_LEAST to STEM_MOST letters above them."""
    words = {w for w in (_EDGES.sub("", raw) for raw in (text or "").lower().split()) if len(w) >= ROOT}
    return Counter(w[:ROOT] for w in words), Counter(w[:n] for w in words for n in range(STEM_LEAST, min(STEM_MOST + 1, len(w))))


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes above two words or more of each text."""
    for batch in slices(batches):
        found = [[s for s, k in _branches(t)[1].items() if k >= 2] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["stems"])


def _branched(wanted: frozenset[str]):
    """Of each text the wanted nodes with their words and those of their roots, and all wanted roots with theirs."""
    roots = {s[:ROOT] for s in wanted}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes, under = [], []
            for text in batch.column("text").to_pylist():
                of, counted = _branches(text)
                nodes.append([{"stem": s, "k": counted[s], "m": of[s[:ROOT]]} for s in counted.keys() & wanted])
                under.append([{"root": r, "m": of[r]} for r in of.keys() & roots])
            kinds = [pa.list_(pa.struct([("stem", pa.string()), ("k", pa.int64()), ("m", pa.int64())])), pa.list_(pa.struct([("root", pa.string()), ("m", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(nodes, kinds[0]), pa.array(under, kinds[1])], ["y", "nodes", "roots"])

    return work


def bent_stems(sample: DataFrame, sizes: dict[int, int]) -> dict[str, float]:
    """The stems of the sample's texts (y, text) and the share of their root's words that they have in clean texts.

    Only nodes that toxic texts repeat are counted in the others, so that what is shuffled are some nodes of each text and not all branches of its words.
    """
    toxic = F.col("y") == 1
    repeated = arrow_map(sample.filter(toxic).select("text"), _repeated, "stems array<string>").select(F.explode("stems").alias("stem"))
    wanted = frozenset(r["stem"] for r in repeated.groupBy("stem").count().filter(F.col("count") >= STEM_TEXTS).collect())  # nodes of the bounded sample's toxic texts
    if not wanted:
        return {}
    counted = written(arrow_map(sample.select("y", "text"), _branched(wanted), "y int, nodes array<struct<stem:string,k:long,m:long>>, roots array<struct<root:string,m:long>>"), "tox-branches")
    nodes = counted.select("y", F.explode("nodes").alias("node")).select("y", "node.*")
    seen = nodes.groupBy("stem").agg(F.count_if(toxic).alias("in_toxic"), F.count_if(~toxic).alias("in_clean"), F.coalesce(F.sum(F.when(~toxic, F.col("k"))), F.lit(0)).alias("clean"))
    odds = F.log((F.col("in_toxic") + 0.5) / (sizes[1] + 1)) - F.log((F.col("in_clean") + 0.5) / (sizes[0] + 1))
    roots = counted.select("y", F.explode("roots").alias("r")).groupBy(F.col("r.root").alias("root")).agg(F.coalesce(F.sum(F.when(~toxic, F.col("r.m"))), F.lit(0)).alias("of"))
    shares = seen.filter(odds >= STEM_ODDS).withColumn("root", F.substring("stem", 1, ROOT)).join(roots, "root").select("stem", ((F.col("clean") + 0.5) / (F.col("of") + 1)).alias("share"))
    each = nodes.join(F.broadcast(shares), "stem").withColumn("expected", F.col("share") * F.col("m"))
    nats = F.when((F.col("k") > 1) & (F.col("k") > F.col("expected")), F.col("k") * F.log(F.col("k") / F.col("expected")) - F.col("k") + F.col("expected")).otherwise(F.lit(0.0))
    found = each.groupBy("stem", "share").agg(F.sum(F.least(nats, F.lit(MOST_NATS)) * F.when(toxic, 1).otherwise(-1)).alias("nats")).filter(F.col("nats") >= STEM_EVIDENCE)
    out: dict[str, float] = {}
    for r in sorted(found.collect(), key=lambda r: (-round(r["nats"], 6), -len(r["stem"]), r["stem"])):  # of a branch the node with the most evidence
        if not any(r["stem"].startswith(s) or s.startswith(r["stem"]) for s in out):
            out[r["stem"]] = float(r["share"])
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits of every row."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model.weights is None:
        scored = chosen.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_hits"))
    else:
        scored = arrow_map(chosen, _measure(model), "doc_id long, score double, n_hits long")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_hits")


def drop_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that are not predicted toxic."""
    if model.weights is None:
        return docs
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].alias("text"))
    kind = packed.schema["row"].dataType.simpleString()
    scored = arrow_map(packed, _measure(model), f"row {kind}, score double, n_hits long")
    return scored.filter(F.col("score") < THRESHOLD).select("row.*")


def op5(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
