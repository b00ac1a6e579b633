"""Ranked lexical search: impact-ordered indexes of document shards, evaluated score at a time.

One scan tokenises the whole texts and keeps, for each document, its length and the counts of those terms that queries have (a written table, the forward index).
From it come the exact statistics N, L and df. Then each task turns its documents into shards of SHARD. In a shard, the postings of a term are ordered by falling impact, so
that postings of equal impact form a group, and an item's groups are added to accumulators from the highest impact down. After each step the bound on what is
left of every term is known. Work on an item stops only when no document outside the candidates can reach the k-th best score that the task has so far (a tie could
still win by its id, so equal bounds stay); the candidates' scores are then completed from the forward index of the shard. The best k of a task go on to
one window by item. Documents never move; what is shuffled is k rows for each item and task at most.

The items go to the tasks in blocks of at most BLOCK_TERMS different terms or MAX_ITEMS items (an item with more terms is a block of its own), whatever their number.

Defined cases: a null or empty text has no terms; such a document does not count in N, such an item has no rows. Each row is a document, repeated ids too; each row of
the items is an item. Equal scores are ordered by doc_id, null ids last. Very long texts count whole. An empty table on either side gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ondula.llm.common import arrow_map, documents, slices, written

TOP = 50
#: Documents of a shard.
SHARD = 8192
#: Different terms and items that go to the tasks at once.
BLOCK_TERMS = 100_000
MAX_ITEMS = 20_000
#: Each step goes down to this part of the impact before.
STEP = 0.4
#: The alphabet of terms in UTF-8: letters, digits, and every byte of a character beyond ASCII. bytes.lower() changes A-Z only.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
FOUND = "terms array<int>, counts array<long>"


def terms(text: bytes | None) -> list[bytes]:
    return _TERM.findall(text.lower()) if text else []


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        lists = [sorted(set(terms(t))) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(lists, pa.list_(pa.binary()))], ["item_id", "terms"])


def _forward(vocabulary: dict[bytes, int]):
    """Length, and the query terms with their counts, of each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for batch in slices(batches):
            sizes, ids, counts = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = terms(text)
                held = Counter(words)
                both = held.keys() & known
                sizes.append(len(words))
                ids.append([vocabulary[w] for w in both])
                counts.append([held[w] for w in both])
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "size", "terms", "counts"])

    return work


class Shard:
    """The impact-ordered index of some documents, and their forward index."""

    def __init__(self, docs: np.ndarray, term: np.ndarray, impact: np.ndarray, size: int, n_terms: int) -> None:
        order = np.lexsort((-impact, term))
        self.docs, self.impacts, self.size = docs[order], impact[order], size
        self.starts = np.searchsorted(term[order], np.arange(n_terms + 1))

    def best(self, items_terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, whole scores, postings read before the stop) of all documents that may be among the k best, given that k documents with `floor` or more are known elsewhere."""
        begins, ends = self.starts[items_terms], self.starts[items_terms + 1]
        held = ends > begins
        begins, ends = begins[held], ends[held]
        nobody = np.empty(0, np.int64)
        if not len(begins):
            return nobody, nobody, 0
        falling = [-self.impacts[b:e] for b, e in zip(begins, ends, strict=True)]
        at = np.zeros(len(begins), np.int64)
        sums, reach = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        threshold = max(-f[0] for f in falling)
        while True:
            threshold = int(threshold * STEP)
            to = np.array([np.searchsorted(f, -threshold, "right") for f in falling])
            for b, i, j in zip(begins, at, to, strict=True):
                sums[self.docs[b + i : b + j]] += self.impacts[b + i : b + j]  # a term has a document once
            at = to
            left = np.array([-f[j] if j < len(f) else 0 for f, j in zip(falling, at, strict=True)])
            rest = int(left.sum())
            least = max(floor, int(np.partition(sums, -k)[-k]) if self.size >= k else 0, 1)
            if rest < least or not rest:  # no document that is not met yet can be among the best
                break
        if rest:
            for b, j, bound in zip(begins, at, left, strict=True):
                reach[self.docs[b : b + j]] += bound
        candidates = np.flatnonzero(sums + (rest - reach) >= least)
        whole = sums[candidates]
        if rest and len(candidates):  # complete their scores
            place = np.full(self.size, -1)
            place[candidates] = np.arange(len(candidates))
            for b, j, e in zip(begins, at, ends, strict=True):
                p = place[self.docs[b + j : e]]
                whole[p[p >= 0]] += self.impacts[b + j : e][p >= 0]
        return candidates, whole, int(at.sum())


def _search(items: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """The best k of the task's documents for each item: item, doc_id, score."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, SHARD):
                batch = whole.slice(start, SHARD)
                ids = batch.column("doc_id")
                known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                lists, counts = batch.column("terms"), batch.column("counts").flatten().to_numpy().astype(np.int64)
                docs = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                length = 50 + (50 * batch.column("size").to_numpy().astype(np.int64) * n_docs) // n_terms
                term = lists.flatten().to_numpy()
                impact = weights[term] * ((1_000_000_000 * counts) // (1000 * counts + 20 * length[docs]))
                some = impact > 0
                shard = Shard(docs[some], term[some], impact[some], batch.num_rows, len(weights))
                for item, its_terms in items:
                    before = best.get(item)
                    floor = int(before[0][-1]) if before and len(before[0]) == k else 0
                    found, score, _ = shard.best(its_terms, k, floor)
                    if not len(found):
                        continue
                    rows = (score, known[found], ids[found])
                    if before:
                        rows = tuple(map(np.concatenate, zip(before, rows, strict=True)))
                    order = np.lexsort((rows[2], ~rows[1], -rows[0]))[:k]
                    best[item] = tuple(r[order] for r in rows)
        for item, (score, known, ids) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), item)), pa.array(ids, pa.int64(), mask=~known), pa.array(score)], ["item", "doc_id", "score"])

    return work


def blocks(items: Iterable) -> Iterator[list[tuple[int, list[bytes]]]]:
    """(item, terms) of rows, as they come, in lists within the bounds."""
    block: list = []
    room = BLOCK_TERMS
    for row in items:
        found = [bytes(t) for t in row["terms"]]
        if block and (len(found) > room or len(block) >= MAX_ITEMS):
            yield block
            block, room = [], BLOCK_TERMS
        block.append((row["item"], found))
        room -= len(found)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, with a score above 0."""
    kind = items.schema[item_col].dataType.simpleString()
    asked = arrow_map(items.select(F.col(item_col).alias("item_id"), F.col(query_col).alias("text")), _distinct_terms, f"item_id {kind}, terms array<binary>")
    asked = written(asked.filter(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id()), "search-items")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    best = None
    for block in blocks(asked.select("item", "terms").toLocalIterator()):
        vocabulary = {w: i for i, w in enumerate(sorted({t for _, ts in block for t in ts}))}
        forward = written(arrow_map(texts, _forward(vocabulary), f"doc_id long, size long, {FOUND}"), "search-forward")
        n_docs, n_terms = forward.agg(F.count_if(F.col("size") > 0), F.coalesce(F.sum("size"), F.lit(0))).first()
        counted = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weighed = counted.select("term", F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long").alias("w")).collect()  # one row a term of the block at most
        if not weighed:
            continue
        weights = np.zeros(len(vocabulary), np.int64)
        weights[[r["term"] for r in weighed]] = [r["w"] for r in weighed]
        lists = [(item, np.array([vocabulary[t] for t in ts], np.int64)) for item, ts in block]
        found = arrow_map(forward.filter(F.size("terms") > 0), _search(lists, weights, n_docs, n_terms, k), "item long, doc_id long, score long")
        best = found if best is None else best.unionByName(found)
    if best is None:
        return items.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    falling = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(falling)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SPLIT = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_SPLIT}, []) AS t FROM documents),
     s AS (SELECT CAST(count(*) FILTER (len(t) > 0) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d),
     q AS (SELECT DISTINCT item_id, unnest({_SPLIT}) AS term FROM benchmark),
     p AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT r, doc_id, unnest(t) AS term, len(t) AS n FROM d) GROUP BY r, term),
     f AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
     g AS (SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
           FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY item_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM g WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
