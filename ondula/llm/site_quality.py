"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic regression over text measures and hashed words gives each document a probability of good quality. Documents are grouped by host and by path below the
host: global -> host -> path. At each level the group's mean is shrunk towards the level above by a prior strength, estimated by the method of moments from the spread
of hosts around the global mean and of paths around their hosts' means, so that a group with few rows stays near its parent. A document's score combines its
own log-odds with what its path's posterior adds to the global log-odds; the posterior is that of the other documents, so none counts for itself twice.

Scale: two scans of the texts (a bounded training sample, then all rows); the measures of the second are written once. Groups are pre-aggregated before the
shuffle to (count, sum, sum of squares), so a host with a third of all rows is one row per task. Group posteriors join back to rows by
a join that Spark broadcasts when the table is small enough and otherwise splits at skewed keys.

Defined cases: a null or empty text has zero measures. A null host or path is a group of its own. Equal rows get equal scores. Without labels of both kinds
the document probability is 0.5. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ondula.llm import logistic
from ondula.llm.common import arrow_map, documents, keep, slices, text_of, written

TRAIN_ROWS = 20_000
THRESHOLD = 0.5
#: How much of the site's log-odds is added to the document's.
SITE_WEIGHT = 0.5
MEASURES = 10
#: Signed buckets that words are hashed to.
BUCKETS = 256
CACHE_WORDS = 200_000
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"


def measures(text: str | None) -> list[float]:
    """Measures of a text, each of about unit size."""
    data = (text or "").encode()
    words = data.split()
    n, size = len(words), max(1, len(data))
    if not n:
        return [1.0] + [0.0] * (MEASURES - 1)
    low = data.lower().split()
    runs = sum(map(bytes.__eq__, low[1:], low))
    lines = [x for x in data.split(b"\n") if x.strip()]
    part = lambda letters: (len(data) - len(data.translate(None, letters))) / size
    return [1.0, 10 * part(_SYMBOLS), 2 * part(_UPPER), 10 * part(b"!?"), 5 * part(_DIGITS), len(set(low)) / n, 3 * runs / n, 1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(n)) / 5, sum(map(len, words)) / n / 8]


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = code = zlib.crc32(word) % (2 * BUCKETS)
        return code


def vectors(texts: list[str | None], buckets: _Buckets) -> np.ndarray:
    """Measures and hashed words of texts, a row each: signed counts by bucket, damped and scaled to the text's length."""
    out = np.zeros((len(texts), MEASURES + BUCKETS))
    for row, text in zip(out, texts, strict=True):
        row[:MEASURES] = measures(text)
        words = (text or "").encode().lower().split()
        if words:
            codes = np.bincount(np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)), minlength=2 * BUCKETS)
            signed = codes[:BUCKETS] - codes[BUCKETS:]
            row[MEASURES:] = np.sign(signed) * np.sqrt(np.abs(signed) / len(words))
    return out


def _score(weights: list[float] | None):
    """Feature rows as float32 bytes, or probabilities when weights are given."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = keep("word buckets", _Buckets)
        for batch in slices(batches):
            if len(buckets) > CACHE_WORDS:
                buckets.clear()
            rows = vectors(batch.column("text").to_pylist(), buckets)
            names = [n for n in batch.schema.names if n != "text"]
            rest = [batch.column(n) for n in names]
            if weights is None:
                yield pa.RecordBatch.from_arrays([*rest, pa.array([r.astype("<f4").tobytes() for r in rows], pa.binary())], [*names, "features"])
            else:
                yield pa.RecordBatch.from_arrays([*rest, pa.array(logistic.sigmoid(rows @ np.array(weights)))], [*names, "p"])

    return work


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> list[float] | None:
    usable = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    usable = usable.groupBy("id").agg(F.max("y").alias("y"))  # an id that labels repeat counts once
    total = usable.count()
    if not total:
        return None
    chosen = usable.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(min(1.0, train_rows / total) * (1 << 20)))
    sample = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "id").select("y", "text")
    rows = arrow_map(sample, _score(None), "y int, features binary").collect()  # at most about train_rows rows of MEASURES + BUCKETS numbers
    y = np.array([float(r["y"]) for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    return logistic.fit(np.stack([np.frombuffer(r["features"], "<f4") for r in rows]).astype(float), y).tolist()


def _strength(groups: DataFrame, parent: str) -> float:
    """Prior strength by moments from (n, total, parent mean): mean (1 - mean) / variance of the groups around their parents - 1, at least 1."""
    mean = F.sum("total") / F.sum("n")
    between = F.sum(F.col("n") * F.pow(F.col("total") / F.col("n") - F.col(parent), 2)) / F.sum("n")
    found = groups.agg(F.greatest(F.lit(1.0), F.least(F.lit(1e6), mean * (1 - mean) / F.greatest(between, F.lit(1e-9)) - 1)).alias("k")).first()["k"]
    return 1.0 if found is None else found


def sites(scored: DataFrame) -> tuple[DataFrame, float, float, float]:
    """(host, path, n_path, total_path, n_host, total_host) from rows (host, path, p); the global mean, and the prior strengths of hosts and paths."""
    paths = written(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("total")), "site-paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "site-hosts")
    mean = hosts.agg(F.sum("total") / F.sum("n")).first()[0]
    mean = 0.5 if mean is None else min(1 - 1e-6, max(1e-6, mean))
    above = hosts.select(F.col("host").alias("h"), F.col("n").alias("n_host"), F.col("total").alias("total_host"))
    joined = paths.join(above, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k_host = _strength(hosts.withColumn("mean", F.lit(mean)), "mean")
    k_path = _strength(joined.withColumn("mean", F.col("total_host") / F.col("n_host")), "mean")
    return written(joined.withColumnsRenamed({"n": "n_path", "total": "total_path"}), "site-posteriors"), mean, k_host, k_path


def classify(docs: DataFrame, weights: list[float] | None, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, doc_probability, host_posterior, path_posterior, score, kept of every row."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).alias("text"))
    scored = arrow_map(chosen, _score(weights if weights is not None else [0.0] * (MEASURES + BUCKETS)), "doc_id long, host string, path string, p double")
    scored = written(scored, "site-scores")
    table, mean, k_host, k_path = sites(scored)
    table = table.withColumnsRenamed({"host": "h", "path": "r"})
    joined = scored.join(table, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("r")))
    # posteriors without the document itself
    of_host = (k_host * mean + F.col("total_host") - F.col("p")) / (k_host + F.col("n_host") - 1)
    of_path = (k_path * F.col("host_posterior") + F.col("total_path") - F.col("p")) / (k_path + F.col("n_path") - 1)
    joined = joined.withColumn("host_posterior", of_host).withColumn("path_posterior", of_path)
    logit = lambda c: F.log(c / (1 - c))
    clip = lambda name: F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col(name)))
    total = logit(clip("p")) + SITE_WEIGHT * (logit(clip("path_posterior")) - logit(F.lit(mean)))
    return joined.select("doc_id", F.col("p").alias("doc_probability"), "host_posterior", "path_posterior", "n_host", "n_path", (1 / (1 + F.exp(-total))).alias("score")).withColumn("kept", F.col("score") >= THRESHOLD)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    weights = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, weights, F.col("source"), F.col("lang"))
