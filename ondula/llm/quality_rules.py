"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths in NumPy.

A word is a run of characters other than SPACE and TAB..CR. For each n of NGRAMS the words' hashes are rolled into window hashes; a window that occurs
twice or more in the text is repeated, and the rule measures the share of the words' characters that lie inside repeated windows, first
occurrence excluded. Lines are measured alike. A text is rejected by its base rules (too short, too many words in repeated 3-word
windows) or when a coverage passes its limit in COVERAGE_LIMITS / LINE_LIMIT / SYMBOL_LIMIT.

Defined cases: a null or empty text has no words and fails the base rules. Equal rows get equal results. An empty table gives no rows. Other columns of the input
are ignored by `measure` and kept by `keep_good`. Work is by row; a very long text is measured whole in one row's NumPy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ondula.llm.common import arrow_map, documents, slices

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: n-gram length -> largest share of characters inside repeated n-grams, first occurrences not counted.
COVERAGE_LIMITS = {2: 0.60, 3: 0.40, 5: 0.30, 8: 0.25, 10: 0.25}
LINE_LIMIT = 0.30
#: Largest number of symbol characters for each word.
SYMBOL_LIMIT = 0.30
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    + ", ".join(f"coverage_{n} double" for n in COVERAGE_LIMITS)
    + ", dup_line_share double, base_failed boolean, kept boolean"
)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of n consecutive words."""
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ hashes[k : len(hashes) - n + 1 + k]) * _PRIME
        out ^= out >> np.uint64(29)
    return out


def covered(count: int, starts: np.ndarray, n: int) -> np.ndarray:
    """Which of `count` words lie inside windows of n words at `starts`."""
    steps = np.zeros(count + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n, -1)
    return np.cumsum(steps[:-1]) > 0


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(in a group of two or more, the same without first occurrences)."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    later = np.zeros(len(keys), bool)
    later[order[1:]] = same
    every = later.copy()
    every[order[:-1]] |= same
    return every, later


def measure_text(text: str | None) -> tuple:
    data = (text or "").encode()
    words = data.split()
    count = len(words)
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lengths = np.fromiter(map(len, words), np.int64, count)
    total = int(lengths.sum())
    chars = len(text or "") - (len(data) - total)
    seen: set[bytes] = set()
    duplicate = line_bytes = 0
    for line in data.split(b"\n"):
        if not line.strip():
            continue
        if line in seen:
            duplicate += 1
            line_bytes += len(line)
        else:
            seen.add(line)
    hashes = np.fromiter(map(hash, words), np.int64, count).view(np.uint64)
    repeated, shares = 0, []
    for n in sorted({3, *COVERAGE_LIMITS}):
        if count < n:
            share = 0.0
        else:
            every, later = repeats(windows(hashes, n))
            if n == 3 and every.any():
                repeated = int(covered(count, np.flatnonzero(every), n).sum())
            share = float(lengths[covered(count, np.flatnonzero(later), n)].sum() / total) if later.any() else 0.0
        if n in COVERAGE_LIMITS:
            shares.append(share)
    line_share = line_bytes / len(data) if data else 0.0
    failed = count < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * count
    good = all(s <= limit for s, limit in zip(shares, COVERAGE_LIMITS.values(), strict=True)) and line_share <= LINE_LIMIT and symbols <= SYMBOL_LIMIT * count
    return count, chars, symbols, duplicate, repeated, *shares, line_share, failed, not failed and good


def _work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = list(zip(*map(measure_text, batch.column("text").to_pylist()), strict=True))
        kinds = [pa.int64()] * 5 + [pa.float64()] * (len(COVERAGE_LIMITS) + 1) + [pa.bool_()] * 2
        columns = [batch.column("doc_id").cast(pa.int64()), *(pa.array(v, t) for v, t in zip(rows, kinds, strict=True))]
        names = [f.strip().split(" ")[0] for f in SCHEMA.split(",")]
        yield pa.RecordBatch.from_arrays(columns, names)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of measures and verdicts per row of docs."""
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), _work, SCHEMA)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        kept = [measure_text(t)[-1] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.bool_())], ["row", "kept"])


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose text the rules keep. Each row is judged by its own text, whatever its id."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].alias("text"))
    kind = packed.schema["row"].dataType.simpleString()
    return arrow_map(packed, _judge, f"row {kind}, kept boolean").filter("kept").select("row.*")


def op7(spark, sf_dir: str) -> DataFrame:
    return measure(documents(spark, sf_dir))
