"""Removal of repeated passages: bytes covered by a LENGTH-byte string that also starts anywhere else in the corpus, same text included.

The method first meant for this operator, a run-compressed Burrows-Wheeler index, is not used; README.md says why, with figures of a prototype. This one finds the same
strings with local hashes, in any number of tasks:

1. Every LENGTH-byte window is named by its anchor, the GRAM-byte string of the smallest hash inside it (leftmost of equals): equal windows have equal anchor hashes.
   Consecutive windows with one anchor position form a region, about one for every 70 bytes.
2. Regions are dealt and sorted by anchor and by a hash of their bytes, once, and read as a stream. A region whose anchor stands alone holds no repeated window and
   goes; regions that occur twice or more are repeated from end to end. What is left are the borders of repeated passages: regions whose anchor is repeated
   with other surroundings. For these, and for one region of every kind that shares their anchor, all windows are hashed.
3. Those windows are dealt and sorted by hash and read as a stream in turn; the ones that occur twice or more are repeated.

Hashes have 64 bits. Streams keep one row of what may go on, so a hot anchor costs time in one task, in proportion to its rows, and no memory. Nothing is gathered but
one text's own intervals, which are fewer than its bytes. Texts are scanned three times; only those with repeated regions meet a shuffle.

The same steps over words instead of bytes find passages of WORDS words or more that occur elsewhere, whatever their length in bytes (`repeated_words`).

Defined cases: a null text is empty; texts of less than LENGTH bytes keep every byte. Repeated rows are places of their own, so they remove each other.
Very long texts are cut into overlapping pieces of PIECE bytes, which does not change the result. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ondula.llm.common import arrow_map, documents, keep, release, slices, text_of, written
from ondula.llm.exact_dedup import filter_bits, filter_of, with_suspicion

LENGTH = 400
GRAM = 256
#: Passages of over 50 words, and their anchors' words.
WORDS = 51
WORD_GRAM = 32
CACHE_WORDS = 100_000
#: Bytes that are hashed together.
PIECE = 1 << 20
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _symbols(texts: list[bytes], by_word: bool) -> list[np.ndarray]:
    """The texts as arrays of bytes, or of word hashes."""
    if not by_word:
        return [np.frombuffer(t, np.uint8) for t in texts]
    known = keep("passage words", _WordHash)
    if len(known) > CACHE_WORDS:
        known.clear()
    return [np.fromiter(map(known.__getitem__, words), np.uint64, len(words)) for words in (t.split() for t in texts)]


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring (or overlapping) strings from their hashes."""
    h = (left * _A) ^ (right + _B + (left >> np.uint64(29)))
    h *= _C
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` bytes at every place, by doubling."""
    h, size = data.astype(np.uint64) * _A + np.uint64(1), 1
    while size * 2 <= length:
        h = _join(h[:-size], h[size:])
        size *= 2
    return h if size == length else _join(h[: len(h) - (length - size)], h[length - size :])


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value of every `width` neighbours, by doubling."""
    at, size = np.arange(len(values), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        left, right = values[:-step], values[step:]
        first = left <= right
        at, values, size = np.where(first, at[:-step], at[step:]), np.where(first, left, right), size + step
    return at


def _pieces(texts: list[np.ndarray], length: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Groups of (row, base, symbols) of about PIECE symbols; long texts in pieces that overlap by length - 1."""
    group, held = [], 0
    for row, data in enumerate(texts):
        if len(data) < length:
            continue
        for base in range(0, len(data) - length + 1, PIECE):
            part = data[base : base + PIECE + length - 1]
            group.append((row, base, part))
            held += len(part)
            if held >= PIECE:
                yield group
                group, held = [], 0
    if group:
        yield group


class _Windows:
    """The windows of a group of pieces: hashes, anchors and regions."""

    def __init__(self, group: list[tuple[int, int, np.ndarray]], length: int, gram: int) -> None:
        data = np.concatenate([p[2] for p in group])
        sizes = np.fromiter((len(p[2]) for p in group), np.int64, len(group))
        self.owner = np.repeat(np.arange(len(group), dtype=np.int32), sizes)
        self.shift = np.fromiter((p[1] for p in group), np.int64, len(group)) - (np.cumsum(sizes) - sizes)
        self.grams = gram_hashes(data, gram)
        self.hashes = _join(self.grams[: len(self.grams) - (length - gram)], self.grams[length - gram :])
        self.inside = self.owner[: len(self.hashes)] == self.owner[length - 1 :]

    def regions(self, width: int) -> tuple[np.ndarray, ...]:
        """(anchor hash, region hash, owner, first window, last window) of the regions."""
        anchor = leftmost_minimum(self.grams, width)
        same = self.inside[1:] & self.inside[:-1] & (anchor[1:] == anchor[:-1])
        first = np.flatnonzero(self.inside & ~np.append(False, same))
        last = np.flatnonzero(self.inside & ~np.append(same, False))
        key = _join(self.hashes[first], self.hashes[last]) + (last - first).astype(np.uint64)
        owner = self.owner[first]
        return self.grams[anchor[first]], key, owner, first + self.shift[owner], last + self.shift[owner]


def _region_rows(length: int, gram: int, by_word: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = batch.column("row_key").to_numpy()
            for group in _pieces(_symbols(batch.column("text").cast("binary").to_pylist(), by_word), length):
                anchor, key, owner, first, last = _Windows(group, length, gram).regions(length - gram + 1)
                own = keys[np.fromiter((p[0] for p in group), np.int64, len(group))][owner]
                columns = [anchor.view(np.int64), key.view(np.int64), own, first.astype(np.int64), last.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "region", "row_key", "first", "last"])

    return work


def _stream(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray | None, bool]]:
    """Sorted rows as matrices that hold one row more than is to be treated, which opens the next one; the row before; and whether it is the last."""
    held, before = np.zeros((len(names), 0), np.int64), None
    for batch in chain(batches, [None]):
        rows = held if batch is None else np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in names])], axis=1)
        n = rows.shape[1] - (batch is not None)
        held = rows
        if n > 0:
            yield rows, before, batch is None
            before, held = rows[:, n - 1], rows[:, n:]


def _same(keys: np.ndarray, before: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the first n columns whether it equals the column before, and the next."""
    equal = (keys[:, 1:] == keys[:, :-1]).all(axis=0)
    first = before is not None and bool((before == keys[:, 0]).all())
    return np.append(first, equal)[:n], np.append(equal, False)[:n]


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of regions sorted by anchor and region: those that occur twice or more (whole), and those whose windows must be looked at: single ones beside
    others of their anchor, and the first one of each other kind there."""
    pending = None  # the first row of an anchor's first kind, which counts if another kind follows
    for rows, before, ended in _stream(batches, ["anchor", "region", "row_key", "first", "last"]):
        n = rows.shape[1] - (not ended)
        near, next_near = _same(rows[:1], None if before is None else before[:1], n)
        alike, next_alike = _same(rows[:2], None if before is None else before[:2], n)
        twice = alike | next_alike
        part = ~twice & (near | next_near)
        starts, ends = np.flatnonzero(~alike), np.flatnonzero(~next_alike)
        k = np.searchsorted(ends, starts)
        done = k < len(ends)
        mixed = near[starts] | (done & next_near[np.append(ends, 0)[np.where(done, k, len(ends))]])
        part[starts[twice[starts] & mixed]] = True
        late = None
        if pending is not None and len(ends):
            late, pending = pending if next_near[ends[0]] else None, None
        if len(starts) and not done[-1] and not near[starts[-1]] and twice[starts[-1]]:
            pending = rows[:, starts[-1]]
        picked = np.concatenate([rows[2:, :n][:, twice], rows[2:, :n][:, part], rows[2:, :0] if late is None else late[2:, None]], axis=1)
        if picked.shape[1]:
            whole = np.arange(picked.shape[1]) < twice.sum()
            yield pa.RecordBatch.from_arrays([*map(pa.array, picked), pa.array(whole)], ["row_key", "first", "last", "whole"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by hash those that occur twice or more."""
    for rows, before, ended in _stream(batches, ["window", "row_key", "at"]):
        n = rows.shape[1] - (not ended)
        twice = np.logical_or(*_same(rows[:1], None if before is None else before[:1], n))
        if twice.any():
            yield pa.RecordBatch.from_arrays([*map(pa.array, rows[1:, :n][:, twice])], ["row_key", "at"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (row_key, first, last) of windows sorted by row and place."""
    going = None
    for batch in chain(batches, [None]):
        if batch is None:
            runs = [] if going is None else [going]
        else:
            key, at = batch.column("row_key").to_numpy(), batch.column("at").to_numpy()
            if not len(at):
                continue
            new = np.append(True, (key[1:] != key[:-1]) | (at[1:] > at[:-1] + 1))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            runs = list(zip(key[first].tolist(), at[first].tolist(), at[last].tolist(), strict=True))
            if going is not None:
                runs[:1] = [(going[0], going[1], runs[0][2])] if runs[0][0] == going[0] and runs[0][1] <= going[2] + 1 else [going, runs[0]]
            going = runs.pop()
        if runs:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*runs, strict=True)], ["row_key", "first", "last"])


def _window_rows(length: int, gram: int, by_word: bool):
    """Hashes of the windows inside a row's `parts`, arrays of (first, last)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, parts = batch.column("row_key").to_numpy(), batch.column("parts").to_pylist()
            for group in _pieces(_symbols(batch.column("text").cast("binary").to_pylist(), by_word), length):
                found = _Windows(group, length, gram)
                want = np.zeros(len(found.hashes) + 1, np.int32)
                for j, (row, base, data) in enumerate(group):
                    for part in parts[row]:
                        a, b = max(part["first"], base), min(part["last"], base + len(data) - length)
                        if a <= b:
                            want[a - found.shift[j]] += 1
                            want[b + 1 - found.shift[j]] -= 1
                at = np.flatnonzero(np.cumsum(want[:-1]) > 0)
                owner = found.owner[at]
                own = keys[np.fromiter((p[0] for p in group), np.int64, len(group))][owner]
                yield pa.RecordBatch.from_arrays([pa.array(found.hashes[at].view(np.int64)), pa.array(own), pa.array(at + found.shift[owner])], ["window", "row_key", "at"])

    return work


def _cover(spans: list[dict] | None, length: int, size: int) -> np.ndarray:
    """The symbols that windows from `first` to `last` of the spans cover."""
    steps = np.zeros(size + 1, np.int32)
    for s in spans or ():
        steps[s["first"]] += 1
        steps[s["last"] + length] -= 1
    return np.cumsum(steps[:-1]) > 0


def _remove(length: int, with_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for data, spans in zip(batch.column("text").cast("binary").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                gone = _cover(spans, length, len(data))
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                starts = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                out.append((len(data), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
            columns = [batch.column("doc_id"), batch.column("row_key"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))]
            names = ["doc_id", "row_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
            yield pa.RecordBatch.from_arrays(columns if with_text else columns[:-1], names if with_text else names[:-1])

    return work


def _count(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for spans in batch.column("spans").to_pylist():
                low = min(s["first"] for s in spans)
                counts.append(int(_cover([{k: v - low for k, v in s.items()} for s in spans], length, max(s["last"] for s in spans) + length - low).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array(counts, pa.int64())], ["row_key", "n_repeated_words"])

    return work


def _holds(rows: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """rows with `suspect`: the row's key is in keys (row_key), or, seldom, only seems to be. No shuffle of rows."""
    bits = filter_bits(n)
    bitmaps = written(filter_of(keys.select(F.col("row_key").alias("key")), bits), "passage-members")
    return with_suspicion(rows.withColumn("key", F.col("row_key")), bitmaps, bits).drop("key")


def _places(texts: DataFrame, length: int, gram: int, by_word: bool) -> DataFrame:
    """(row_key, spans), written: for each row with repeated windows their runs (first, last)."""
    regions = arrow_map(texts, _region_rows(length, gram, by_word), "anchor long, region long, row_key long, first long, last long")
    dealt = regions.repartition("anchor").sortWithinPartitions("anchor", "region", "row_key", "first")
    kinds = written(arrow_map(dealt, _kinds, "row_key long, first long, last long, whole boolean"), "passage-kinds")
    parts = written(kinds.filter("not whole").groupBy("row_key").agg(F.collect_set(F.struct("first", "last")).alias("parts")), "passage-parts")
    some = _holds(texts, parts.select("row_key"), max(1, parts.count())).filter("suspect").drop("suspect")
    windows = arrow_map(some.join(parts.hint("merge"), "row_key"), _window_rows(length, gram, by_word), "window long, row_key long, at long")
    twice = arrow_map(windows.repartition("window").sortWithinPartitions("window"), _repeated, "row_key long, at long")
    runs = arrow_map(twice.repartition("row_key").sortWithinPartitions("row_key", "at"), _joined, "row_key long, first long, last long")
    spans = kinds.filter("whole").select("row_key", "first", "last").unionByName(runs).groupBy("row_key").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    found = written(spans, "passage-spans")
    release(kinds, parts)
    return found


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.xxhash64(id_col, text_of(text_col)).alias("row_key"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, row_key (hash of id and text), n_bytes, n_removed, n_spans, kept_sha256 of every row; with_text adds kept_text, without the broken characters at cut edges."""
    if not gram < length <= 2 * gram:
        raise ValueError("gram must be at least half of length, and shorter")
    rows = _rows(docs, id_col, text_col)
    marks = _places(rows.select("row_key", "text"), length, gram, False)
    tested = _holds(rows, marks.select("row_key"), max(1, marks.count()))
    marked = tested.filter("suspect").join(marks.hint("merge"), "row_key", "left").select("doc_id", "row_key", "text", "spans")
    clean = tested.filter("not suspect").select("doc_id", "row_key", "text", F.lit(None).cast("array<struct<first:long,last:long>>").alias("spans"))
    schema = "doc_id long, row_key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return arrow_map(clean.unionByName(marked), _remove(length, with_text), schema)


def repeated_words(docs: DataFrame, words: int = WORDS, gram: int = WORD_GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, n_repeated_words) of the rows in which passages of `words` words or more also start anywhere else: the words inside such passages."""
    places = _places(_rows(docs, id_col, text_col).select("row_key", "text"), words, gram, True)
    return written(arrow_map(places, _count(words), "row_key long, n_repeated_words long"), "passage-words")


def op4(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_repeated_words: words inside passages of over 50 words that occur elsewhere, which may be shorter than LENGTH bytes."""
    docs = documents(spark, sf_dir)
    words = repeated_words(docs)
    removed = remove_repeats(docs).join(words, "row_key", "left")
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("n_repeated_words", F.lit(0).cast("long")).alias("n_repeated_words"))
