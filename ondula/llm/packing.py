"""Packing token sequences with little padding, by non-negative least squares over shallow length combinations.

Every document is tokenised once, gets the end id, and is cut into pieces of at most `window` ids: whole windows first, then its rest. Whole windows are
sequences of their own. The rests' length histogram (at most `window` bins, whatever the corpus) goes to the driver, which enumerates
combinations of two and three lengths that fill a window exactly and solves their repeat counts against the histogram by non-negative least
squares; all lengths take part, and the residual is logged. Each partition of pieces then takes its share of the plan - the solved counts scaled to its own histogram, rounded
down - and packs what is left over by best fit, longest first. Sequences never cross partitions, so packing needs no shuffle of texts and no global order;
sequence ids are the partition number in the high bits and a counter below. A partition is read in sorted order, so a task that is run again makes the same sequences.

Padding: sequences are padded to `window`, except at a power of two. Pieces that are a power of two long may stay alone.

Defined cases: a null or empty text is one id long, the end id. Equal rows make equal pieces, which lie in different places. A very long text becomes many whole
windows. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import logging
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ondula.llm.common import arrow_map, documents, keep, slices, tidy, written
from ondula.llm.tokens import default_path, library_ids, rank_encoder

log = logging.getLogger("ondula")

WINDOW = 1024
END_ID = 0
#: Texts with such runs go to the tokenizers library; the encoder of the others has limits there.
_LONG_RUN = re.compile(r"\s{1000}|\S{4000}")
#: Pieces that one packing task takes; a task's leftovers cost at most a few sequences.
TASK_PIECES = 200_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


def _cut(path: str, window: int, end_id: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, library = keep(("pack", path), lambda: (rank_encoder(path), cache(lambda: library_ids(path))))  # few texts need the library
        for batch in slices(batches):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                own_ids = library()([text]).flat if _LONG_RUN.search(text) else coder.encode_to_numpy(text, allowed_special="all")
                ids = np.append(own_ids, end_id).astype("<u4")
                for start in range(0, len(ids), window):
                    own = ids[start : start + window]
                    for column, value in zip(rows, (doc, start, len(own), zlib.crc32(own.tobytes()), len(ids)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return work


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents with their checksums: one pass over the texts."""
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), _cut(path, window, end_id), PIECES)


def combinations(histogram: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """All pairs and triples of the histogram's lengths that fill the window exactly: rows of ascending lengths, a pair with 0 in front."""
    have = np.zeros(window + 1, bool)
    have[[n for n in histogram if 0 < n < window]] = True
    present = np.append(0, np.flatnonzero(have))
    a, b = present[:, None], present[None, 1:]
    c = window - a - b
    i, j = np.nonzero((a <= b) & (b <= c) & have[np.clip(c, 0, window)])
    return np.stack([present[i], present[1 + j], c[i, j]], axis=1).reshape(-1, 3)


def solve(histogram: dict[int, int], combos: np.ndarray, tolerance: float = 2e-3, rounds: int = 1_000) -> tuple[np.ndarray, float]:
    """Repeat counts x >= 0 with small |A x - h|, by multiplicative steps (A and h have no negative entries, so every step lowers the norm); and |A x - h| / |h|.

    The steps end when fifty of them lower the norm by less than `tolerance` of |h|. What is not covered is packed greedily, so a residual costs padding only.
    """
    size = int(combos.max(initial=0)) + 1
    h = np.zeros(max(size, max(histogram, default=0) + 1))
    h[list(histogram)] = list(histogram.values())
    h[0] = 0.0
    flat = combos.ravel()
    back = lambda v: v[combos].sum(axis=1)

    def there(x: np.ndarray) -> np.ndarray:
        covered = np.bincount(flat, np.repeat(x, 3), len(h))
        covered[0] = 0.0
        return covered

    wanted = back(h)
    x = np.full(len(combos), h.sum() / max(1, 3 * len(combos)))
    norm, before, left = max(float(np.linalg.norm(h)), 1e-300), np.inf, 1.0
    for k in range(rounds if len(combos) else 0):
        covered = there(x)
        if k % 50 == 0:
            left = float(np.linalg.norm(covered - h)) / norm
            if before - left < tolerance:
                break
            before = left
        x *= wanted / np.maximum(back(covered), 1e-300)
    return x, left


def pack(lengths: np.ndarray, plan: list[tuple[tuple[int, ...], float]], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence number and offset of each piece, and the number of sequences. plan: combinations with their share of this task, rounded down here."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks: dict[int, list[int]] = defaultdict(list)
    made = 0
    for i, n in enumerate(lengths.tolist()):
        if n == window:
            sequence[i], made = made, made + 1
        else:
            stacks[n].append(i)
    for combo, count in plan:
        need = {n: combo.count(n) for n in combo}
        for _ in range(min(int(count), *(len(stacks.get(n, ())) // k for n, k in need.items()))):
            at = 0
            for n in combo:
                i = stacks[n].pop()
                sequence[i], offset[i], at = made, at, at + n
            made += 1
    room: list[tuple[int, int]] = []  # (free ids, sequence), sorted
    for n in sorted((n for n in stacks if stacks[n]), reverse=True):
        for i in reversed(stacks[n]):
            k = bisect_left(room, (n, -1))
            if k < len(room):
                free, own = room.pop(k)
            else:
                free, own, made = window, made, made + 1
            sequence[i], offset[i] = own, window - free
            if free > n:
                insort(room, (free - n, own))
    return sequence, offset, made


def _pack_partition(plan: list[tuple[tuple[int, ...], float]], totals: dict[int, int], window: int):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId() << 40
        begun, group, held = 0, [], 0

        def flush() -> pd.DataFrame:
            nonlocal begun
            frame = pd.concat(group, ignore_index=True).sort_values(["length", "doc_id", "start"], kind="stable", ignore_index=True)
            lengths = frame["length"].to_numpy()
            own = np.bincount(lengths, minlength=window + 1)
            share = [(c, x * min(own[n] / totals[n] for n in c)) for c, x in plan]
            sequence, offset, made = pack(lengths, share, window)
            frame["sequence_id"], frame["offset"] = task + begun + sequence, offset
            begun += made
            return frame

        for frame in frames:
            if len(frame):
                group.append(frame)
                held += len(frame)
            if held >= TASK_PIECES:
                yield flush()
                group, held = [], 0
        if group:
            yield flush()

    return work


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its place: PACKED."""
    cut = written(pieces(docs, path or default_path("byte_bpe_50k.json"), window, end_id, id_col, text_col), "pack-pieces")
    rows = cut.filter(F.col("length") < window).groupBy("length").count().collect()  # at most `window` rows
    histogram = {int(r["length"]): int(r["count"]) for r in rows}
    combos = combinations(histogram, window)
    counts, left = solve(histogram, combos)
    log.info("%d combinations leave %.4f of the histogram's norm to greedy packing", len(combos), left)
    plan = [(tuple(n for n in c if n), x) for c, x in zip(combos.tolist(), counts.tolist(), strict=True) if x >= 1]
    total = cut.count()
    parts = max(1, -(-total // TASK_PIECES))
    dealt = cut.repartition(parts, F.xxhash64("doc_id", "start")).sortWithinPartitions("doc_id", "start", "length", "ids_crc32")
    return dealt.mapInPandas(tidy(_pack_partition(plan, histogram, window)), PACKED)


def op6(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
