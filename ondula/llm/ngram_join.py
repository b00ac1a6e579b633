"""Exact n-gram Jaccard join with set-relation skipping.

A document's set holds the hashes of its distinct WORDS-word shingles. Two documents link when their sets' Jaccard similarity is THRESHOLD / 100 or more; the result is
each document's connected component under these links, which is exact.

1. Equal sets have equal answers: they are grouped by a 128-bit digest and one of them, the representative, is joined for all.
2. Index lists: every representative posts the prefix of its set under one order - frequent tokens last, the rest by hash - that two linked sets must share a
   token of. A posting holds the token's position and the set's size. Postings are dealt and sorted by token and position once; tasks read the sorted lists
   as a stream, drop those of one entry and name the entry of the smallest position leader: the fewest rare tokens precede it, so it is the most typical member.
3. Answers from a similar set: every member is compared with the leaders of its lists only. Where they link, the leader's answers stand for the member's. A second
   round, under other leaders, follows.
4. What is left exactly: lists are read again, sorted by component, in blocks of BLOCK entries. Members of one component are skipped, with all blocks that hold no
   other. Blocks of one list meet only where their sizes and positions let two sets reach the overlap: two sets that first meet at positions i, j overlap in at
   most min(n_a - i, n_b - j). Of a list's blocks only those outside its largest component look for partners. Entries carry a small parity sketch, so that pairs
   that only share a passage go before they are made: the Hamming distance of sketches never exceeds the symmetric difference.
5. Every pair is tested by larger sketches, and what is left by its whole sets.

Lists, partners and candidates have no cap. A list of a token that more than SPLIT sets share is dealt in parts, each with a leader, whose leaders meet in turn. A set
with many partners is copied once for every SPREAD of them. Only a bounded number of token weights (FREQUENT) goes to the driver and, as a broadcast, to the tasks; any
order is exact, and tokens beyond it keep their hash order.

Defined cases: a null or empty text has an empty set, links with nothing and is its own component. With fewer than WORDS words the whole
sequence is the one shingle. Repeated rows of one id and text are listed as they stand and share a component. Very long texts are taken whole. An empty table gives no
rows. Columns other than id and text are ignored by `near_duplicates` and kept by `drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ondula.llm.common import arrow_map, documents, keep, release, slices, stored, written, written_whole
from ondula.llm.components import components
from ondula.llm.exact_dedup import BITMAP_BITS, filter_bits, filter_of, with_suspicion

WORDS = 5
THRESHOLD = 80
#: Entries of a list that are compared in one go.
BLOCK = 64
#: Entries of a list that one task may read.
SPLIT = 1 << 20
#: Partners that share one copy of a set.
SPREAD = 256
#: A token that this many sets of one slice of texts share counts there; FREQUENT tokens with the highest counts are ordered by them.
LOCAL_FREQUENT = 2
LEAST_COUNT = 4
FREQUENT = 1 << 18
CACHE_WORDS = 100_000
#: Bytes of the sketch that list entries carry.
SMALL = 64
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[1]
    h = (h ^ (h >> np.uint64(29))) * _ODD[3]
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, words: int = WORDS, known: _WordHash | None = None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text. `known` keeps the hashes of words from call to call, within a bound."""
    parts = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not parts:
        return np.zeros(0, np.uint64)
    known = _WordHash() if known is None else known
    if len(known) > CACHE_WORDS:
        known.clear()
    h = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, np.uint64(size))
    for k in range(size):
        out = (out + h[k : len(h) - size + 1 + k]) * _ODD[k % 5]
        out ^= out >> np.uint64(30)
    return np.unique(_mix(out))


def required(size: int | np.ndarray):
    """The least overlap with any linked set: ceil(THRESHOLD / 100 * size)."""
    return -(-size * THRESHOLD // 100)


def sketch(tokens: np.ndarray) -> bytes:
    """Parity of the tokens on each of a power of two of places, two to four a token between 8 * SMALL and 8,192 in all."""
    places = 8 * SMALL
    while places < min(8192, 2 * len(tokens)):
        places *= 2
    counts = np.bincount((tokens & np.uint64(places - 1)).astype(np.int64), minlength=places)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(data: bytes, size: int) -> np.ndarray:
    """A sketch on fewer places."""
    return np.bitwise_xor.reduce(np.frombuffer(data, np.uint8).reshape(-1, size), axis=0)


def _apart_enough(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sketches (rows of numbers) rule out a link. With a union of u and an overlap o >= t u the symmetric difference, u - o, is at most (1 - t) / (1 + t) of the sizes' sum."""
    different = (a ^ b).view(f"u{a.itemsize}")  # the count is that of the absolute value, which signed numbers would change
    return np.bitwise_count(different).sum(axis=1, dtype=np.int64) * (100 + THRESHOLD) > (100 - THRESHOLD) * sizes


_INFO = "kind int, doc_id long, text_key long, n long, s1 long, s2 long, sketch binary, small binary"


def _info(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0: a document's set size, digest and sketch. Kind 1: a token (s1) that n sets of a slice share."""
    known = keep("shingle words", _WordHash)
    for batch in slices(batches):
        sets = [shingle_set(t, known=known) for t in batch.column("text").to_pylist()]
        sums = [int(x.sum(dtype=np.uint64)) for x in sets]
        xors = [int(np.bitwise_xor.reduce(_mix(x + _ODD[2]))) if len(x) else 0 for x in sets]
        seen, counts = np.unique(np.concatenate(sets), return_counts=True)
        often = counts >= LOCAL_FREQUENT
        extra = int(often.sum())
        signed = lambda v: np.array(v, np.uint64).view(np.int64)
        sketches = [sketch(x) for x in sets]
        columns = [
            pa.array([0] * len(sets) + [1] * extra, pa.int32()),
            pa.concat_arrays([batch.column("doc_id").cast(pa.int64()), pa.nulls(extra, pa.int64())]),
            pa.concat_arrays([batch.column("text_key"), pa.nulls(extra, pa.int64())]),
            pa.array(np.concatenate([[len(x) for x in sets], counts[often]]).astype(np.int64)),
            pa.array(np.concatenate([signed(sums), seen[often].view(np.int64)])),
            pa.array(np.concatenate([signed(xors), np.zeros(extra, np.int64)])),
            pa.array(sketches + [None] * extra, pa.binary()),
            pa.array([folded(x, SMALL).tobytes() for x in sketches] + [None] * extra, pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "doc_id", "text_key", "n", "s1", "s2", "sketch", "small"])


_POSTING = "token long, salt int, rep long, place int, n int"


def _post(weights_of, split: int):
    """Postings of the prefixes. weights_of: broadcast (sorted tokens, their counts)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, weights = weights_of.value
        known = keep("shingle words", _WordHash)
        for batch in slices(batches):
            ids, tokens, places, sizes, salts = [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = shingle_set(text, known=known)
                n = len(own)
                if not n:
                    continue
                k = n - int(required(n)) + 1
                weight = np.zeros(n, np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                    weight = np.where(frequent[at] == own, weights[at], 0)
                    order = np.argsort(weight, kind="stable")[:k]
                    own, weight = own[order], weight[order]
                parts = -(-weight[:k] // split)
                ids.append(np.full(k, doc))
                tokens.append(own[:k])
                places.append(np.arange(k))
                sizes.append(np.full(k, n))
                salts.append(np.where(parts > 1, np.int64(xxhash.xxh3_64_intdigest(str(doc)) >> 1) % np.maximum(parts, 1), -1))
            if ids:
                columns = [np.concatenate(tokens).view(np.int64), np.concatenate(salts).astype(np.int32), np.concatenate(ids).astype(np.int64), np.concatenate(places).astype(np.int32), np.concatenate(sizes).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "salt", "rep", "place", "n"])

    return work


def _fits(n_a, place_a, n_b, place_b):
    """Sizes and positions allow a link between two members of a list, if it is the first that they share."""
    most = np.minimum(n_a - place_a, n_b - place_b)
    return (100 * n_a >= THRESHOLD * n_b) & (100 * n_b >= THRESHOLD * n_a) & ((100 + THRESHOLD) * most >= THRESHOLD * (n_a + n_b))


def _columns(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])


def _starts(rows: np.ndarray) -> np.ndarray:
    """Where a new (token, salt) begins."""
    return np.flatnonzero(np.append(True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries, sorted by list, of lists with two entries or more. leader: the list's first entry where it may link; many: three entries or more, or a part of a list; first: it leads.

    Of a list that may go on in the next batch only its leader and, below three entries, its entries are kept.
    """
    names = ["token", "salt", "rep", "place", "n", "component"]
    held, going = np.zeros((6, 0), np.int64), None
    for batch in chain(batches, [None]):
        rows = held if batch is None else np.concatenate([held, _columns(batch, names)], axis=1)
        if not rows.shape[1]:
            continue
        starts = _starts(rows)
        lengths = np.diff(np.append(starts, rows.shape[1]))
        lead, many, first = rows[:, starts], (lengths >= 3) | (rows[1, starts] >= 0), np.ones(len(starts), bool)
        if going is not None and (rows[:2, 0] == going[:2]).all():
            lead[:, 0], many[0], first[0] = going, True, False
        held, going = rows[:, :0], None
        if batch is not None:
            if many[-1]:
                going = lead[:, -1]
            else:
                held = rows[:, starts[-1] :]
        keep = np.repeat((lengths > 1) | many, lengths)
        keep[rows.shape[1] - held.shape[1] :] = False
        led = np.zeros(rows.shape[1], bool)
        led[starts[first]] = True
        head, many = np.repeat(lead, lengths, axis=1)[:, keep], np.repeat(many, lengths)[keep]
        rows, led = rows[:, keep], led[keep]
        if not rows.shape[1]:
            continue
        meets = (rows[2] != head[2]) & (rows[5] != head[5]) & _fits(rows[4], rows[3], head[4], head[3])
        columns = [pa.array(rows[0]), pa.array(rows[1].astype(np.int32)), pa.array(rows[2]), pa.array(rows[3].astype(np.int32)), pa.array(rows[4].astype(np.int32)), pa.array(head[2], mask=~meets), pa.array(many), pa.array(led)]
        yield pa.RecordBatch.from_arrays(columns, ["token", "salt", "rep", "place", "n", "leader", "many", "first"])


_OPEN = "a long, b long, token long, block long, n_low int, n_high int, tail int, low long, high long, reps array<long>, places array<int>, ns array<int>, components array<long>, smalls binary"


def _open(block: int):
    """Pairs (a, b) inside blocks of lists sorted by component, and the blocks of lists that have several: sizes, longest rest, components, entries."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "salt", "rep", "place", "n", "component"]
        schema = pa.schema([(c, t) for c, t in zip("a b token block n_low n_high tail low high".split(), [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.int64()] * 2, strict=True)] + [("reps", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("ns", pa.list_(pa.int32())), ("components", pa.list_(pa.int64())), ("smalls", pa.binary())])
        held, going, number = np.zeros((6 + SMALL // 8, 0), np.int64), None, TaskContext.get().partitionId() << 33
        for batch in chain(batches, [None]):
            rows = held
            if batch is not None:
                small = np.frombuffer(b"".join(batch.column("small").to_pylist()), np.int64).reshape(-1, SMALL // 8)
                rows = np.concatenate([held, np.concatenate([_columns(batch, names), small.T])], axis=1)
            if not rows.shape[1]:
                continue
            starts = _starts(rows)
            lengths = np.diff(np.append(starts, rows.shape[1]))
            inside = np.arange(rows.shape[1]) - np.repeat(starts, lengths)
            cuts = np.flatnonzero(inside % block == 0)
            sizes = np.diff(np.append(cuts, rows.shape[1]))
            follows = (inside[cuts] > 0) | ((rows[:2, cuts] == going[:, None]).all(axis=0) if going is not None else False)
            goes_on = np.append(inside[cuts[1:]] > 0, False)
            last = len(cuts)
            if batch is not None:
                last -= 1
                held, going = rows[:, cuts[-1] :], rows[:2, cuts[-1]] if follows[-1] else None
            whole = follows | goes_on | (rows[1, cuts] >= 0)
            found = []
            for size in np.unique(sizes[:last]):
                if size < 2:
                    continue
                i, j = np.triu_indices(size, 1)
                of = cuts[:last][sizes[:last] == size]
                for few in np.array_split(of, max(1, len(of) * len(i) // 500_000)):
                    found.append(_linkable(rows[2:], (few[:, None] + i).ravel(), rows[2:], (few[:, None] + j).ravel()))
            if found and sum(x.shape[1] for x in found):
                a, b = np.concatenate(found, axis=1)
                none = {f.name: pa.nulls(len(a), f.type) for f in schema}
                yield pa.RecordBatch.from_arrays(list((none | {"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))}).values()), schema=schema)
            out = []
            for at, size in zip(cuts[:last][whole[:last]], sizes[:last][whole[:last]], strict=True):
                token, _, reps, places, ns, parts = rows[:6, at : at + size]
                number += 1
                bounds = (int(ns.min()), int(ns.max()), int((ns - places).max()), int(parts.min()), int(parts.max()))
                out.append((None, None, int(token[0]), number, *bounds, reps, places.astype(np.int32), ns.astype(np.int32), parts, rows[6:, at : at + size].T.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return work


def _linkable(left: np.ndarray, i: np.ndarray, right: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs (rep, rep) of entries i and j that components, sizes, positions and sketches leave. Rows: rep, place, n, component, sketch."""
    a, b = left[:4, i], right[:4, j]
    good = np.flatnonzero((a[3] != b[3]) & (a[0] != b[0]) & _fits(a[2], a[1], b[2], b[1]))
    good = good[~_apart_enough(left[4:, i[good]].T, right[4:, j[good]].T, a[2, good] + b[2, good])]
    return np.stack([a[0, good], b[0, good]])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs between two blocks of a list."""
    for batch in batches:
        for row in batch.to_pylist():
            sides = [np.concatenate([np.array([row[f"{c}_{k}"] for c in ("reps", "places", "ns", "components")], np.int64), np.frombuffer(row[f"smalls_{k}"], np.int64).reshape(-1, SMALL // 8).T]) for k in "ab"]
            i, j = np.indices((sides[0].shape[1], sides[1].shape[1]))
            a, b = _linkable(sides[0], i.ravel(), sides[1], j.ravel())
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = keep("shingle words", _WordHash)
    for batch in slices(batches):
        sets = [shingle_set(t, known=known).view(np.int64) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["rep", "tokens"])


def _sketch_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that may link by their sketches; the longer sketch is folded onto the shorter one."""
    for batch in batches:
        a, b = batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist()
        sizes = np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
        both = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
        good = np.zeros(batch.num_rows, bool)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            good[at] = ~_apart_enough(*(np.stack([folded(side[i], size) for i in at]) for side in (a, b)), both[at])
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))


def _members(ids: DataFrame, bits: int) -> DataFrame:
    """Bitmaps of the positions of ids (column key): a filter of fixed size for one scan of the texts."""
    return written_whole(filter_of(ids, bits), "ngram-members", bits // BITMAP_BITS)


def _only(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The rows of docs (doc_id, text) whose id is in ids (key), and a few others, without a shuffle of texts."""
    bits = filter_bits(n)
    return with_suspicion(docs.withColumn("key", F.col("doc_id")), _members(ids, bits), bits).filter("suspect").select("doc_id", "text")


def _attach(pairs: DataFrame, table: DataFrame, busy: DataFrame, side: str) -> DataFrame:
    """pairs with the columns of table (rep, ...) for one side, a or b. A rep that is busy (id, parts) has one copy for each part of its partners."""
    other = "b" if side == "a" else "a"
    columns = [c for c in table.columns if c != "rep"]
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = pairs.join(busy.withColumnRenamed("id", side), side, "left").withColumn("part", F.pmod(F.xxhash64(other), parts)).drop("parts")
    copies = table.join(busy.withColumnRenamed("id", "rep"), "rep", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    copies = copies.select(F.col("rep").alias(side), "part", *[F.col(c).alias(f"{c}_{side}") for c in columns])
    return dealt.join(copies.hint("merge"), [side, "part"]).drop("part")


class _Join:
    """The tables of one join."""

    def __init__(self, docs: DataFrame) -> None:
        self.docs = docs
        every = written(arrow_map(docs.withColumn("text_key", F.xxhash64("text")), _info, _INFO), "ngram-info")
        self.info = every.filter("kind = 0").drop("kind")
        self.total = max(1, self.info.count())
        alike = self.info.filter("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.any_value("sketch").alias("sketch"), F.any_value("small").alias("small"))
        self.reps = written(alike, "ngram-reps", self.total)
        often = every.filter("kind = 1").groupBy("s1").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT).orderBy(F.desc("n"), "s1").limit(FREQUENT).toPandas()
        often = often.assign(token=often["s1"].to_numpy(np.int64).view(np.uint64)).sort_values("token")
        self.weights = docs.sparkSession.sparkContext.broadcast((often["token"].to_numpy(), often["n"].to_numpy(np.int64)))

    def lists(self, split: int = SPLIT) -> DataFrame:
        """The entries of lists with two entries or more, with their leaders."""
        own = _only(self.docs, self.reps.select(F.col("rep").alias("key")), self.total)
        posted = arrow_map(own, _post(self.weights, split), _POSTING)
        return written(_led(posted.withColumn("component", F.col("rep")), F.col("place")), "ngram-lists")

    def links(self, pairs: DataFrame, rows: int | None = None) -> DataFrame:
        """The pairs (a, b) that link, as (u, v). rows: a bound on the pairs, where one is known."""
        pairs = written(pairs, "ngram-pairs", rows)
        rows = pairs.count()
        side = lambda c: pairs.groupBy(F.col(c).alias("id")).agg(F.ceil(F.count(F.lit(1)) / SPREAD).alias("parts")).filter("parts > 1")
        busy = written(side("a").unionByName(side("b")).groupBy("id").agg(F.max("parts").alias("parts")), "ngram-busy", 2 * rows // SPREAD)
        sketches = self.reps.select("rep", "n", "sketch")
        near = _attach(_attach(pairs, sketches, busy, "a"), sketches, busy, "b")
        near = written(arrow_map(near, _sketch_pass, "a long, b long").distinct(), "ngram-near", rows)
        ids = written(near.select(F.col("a").alias("key")).union(near.select(F.col("b").alias("key"))).distinct(), "ngram-ids", 2 * rows)
        sets = written(arrow_map(_only(self.docs, ids, max(1, ids.count())), _sets, "rep long, tokens array<long>").join(ids.withColumnRenamed("key", "rep"), "rep", "left_semi"), "ngram-sets")
        both = _attach(_attach(near, sets, busy, "a"), sets, busy, "b")
        shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
        sizes = F.size("tokens_a") + F.size("tokens_b")
        found = written(both.filter((100 + THRESHOLD) * shared >= THRESHOLD * sizes).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "ngram-links", rows)
        release(pairs, busy, near, ids, sets)
        return found


def _led(entries: DataFrame, order: F.Column) -> DataFrame:
    """Entries dealt by list and read in the given order."""
    dealt = entries.withColumn("order", order).repartition("token", "salt").sortWithinPartitions("token", "salt", "order", "n", "rep")
    return arrow_map(dealt.drop("order"), _stars, _POSTING + ", leader long, many boolean, first boolean")


def _pairs_of(lists: DataFrame) -> DataFrame:
    """Distinct pairs of member and leader; leaders of the parts of one list meet the first of them."""
    heads = lists.filter("first and salt >= 0").select("token", "rep", "place", "n")
    top = heads.groupBy("token").agg(F.min_by("rep", F.struct("place", "n", "rep")).alias("leader"))
    met = lists.filter("leader is not null").select("rep", "leader").unionByName(heads.join(top, "token").filter("rep <> leader").select("rep", "leader"))
    return met.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()


def _labelled(lists: DataFrame, known: DataFrame) -> DataFrame:
    """The entries of lists with three or more, with each member's component."""
    many = lists.filter("many").select("token", "salt", "rep", "place", "n")
    return many.join(known.select(F.col("id").alias("rep"), "component").hint("merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _open_pairs(lists: DataFrame, known: DataFrame, reps: DataFrame, block: int) -> DataFrame:
    """All pairs across components that a list and small sketches allow."""
    entries = _labelled(lists, known).join(reps.select("rep", "small").hint("merge"), "rep")
    dealt = entries.repartition("token", "salt").sortWithinPartitions("token", "salt", "component", "place", "n", "rep")
    rows = written(arrow_map(dealt, _open(block), _OPEN), "ngram-open")
    blocks = rows.filter("block is not null").drop("a", "b")
    sizes = blocks.filter("low = high").groupBy("token", "low").agg(F.sum(F.size("reps")).alias("k"))
    main = stored(sizes.groupBy("token").agg(F.max_by("low", F.struct("k", "low")).alias("main")))
    ranked = written(blocks.join(main, "token", "left").withColumn("apart", ~F.coalesce((F.col("low") == F.col("high")) & (F.col("low") == F.col("main")), F.lit(False))), "ngram-blocks")
    main.unpersist()
    a, b = (ranked.select("token", *[F.col(c).alias(f"{c}_{k}") for c in ranked.columns if c != "token"]) for k in "ab")
    meet = F.expr("not apart_b or block_a < block_b") & F.expr("not (low_a = high_a and low_b = high_b and low_a = low_b)")
    sizes = (100 * F.col("n_high_a") >= THRESHOLD * F.col("n_low_b")) & (100 * F.col("n_high_b") >= THRESHOLD * F.col("n_low_a"))
    reach = (100 + THRESHOLD) * F.least("tail_a", "tail_b") >= THRESHOLD * (F.col("n_low_a") + F.col("n_low_b"))
    met = a.filter("apart_a").join(b, "token").filter(meet & sizes & reach)
    across = arrow_map(met.select(*[f"{c}_{k}" for k in "ab" for c in ("reps", "places", "ns", "components", "smalls")]), _across, "a long, b long")
    return rows.filter("a is not null").select("a", "b").unionByName(across).distinct()


def _known(links: DataFrame) -> DataFrame:
    """The components of links, written."""
    rows = links.count()
    return written(components(links, rows=rows), "ngram-known", 2 * rows)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and text_key (hash of the text) of every row of docs."""
    join = _Join(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    lists = join.lists(split)
    links = join.links(_pairs_of(lists), 2 * lists.count())
    known = _known(links)
    second = written(_led(_labelled(lists, known), F.xxhash64("rep")), "ngram-second")
    links = links.unionByName(join.links(_pairs_of(second), 2 * second.count()))
    release(known, second)
    known = _known(links)
    last = join.links(_open_pairs(lists, known, join.reps, block))
    release(known, lists)
    known = _known(links.unionByName(last))
    named = join.reps.join(known.select(F.col("id").alias("rep"), "component"), "rep", "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component"))
    named = written(named, "ngram-named", join.total)
    release(join.reps, known)
    return join.info.drop("sketch", "small").join(named, ["s1", "s2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), "text_key")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that have the smallest id of their component."""
    gone = near_duplicates(docs, id_col, text_col).filter("component_id <> doc_id").select(F.xxhash64("doc_id", "text_key").alias("key"))
    gone = written(gone.distinct(), "ngram-gone", docs.count())
    n = max(1, gone.count())
    own = F.xxhash64(docs[id_col].cast("long"), F.xxhash64(docs[text_col]))
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), own.alias("key"))
    tested = with_suspicion(keyed, _members(gone, filter_bits(n)), filter_bits(n))  # most rows that stay meet no shuffle
    return tested.filter("not suspect").select("row.*").unionByName(tested.filter("suspect").join(gone, "key", "left_anti").select("row.*"))


def op3(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("text_key")


OP3_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
     n AS (SELECT doc_id, len(s) AS n FROM s),
     t AS (SELECT doc_id, unnest(s) AS t FROM s),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
     e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
     u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
     c AS (WITH RECURSIVE r(id, top) AS (SELECT doc_id, doc_id FROM n UNION SELECT u.b, r.top FROM r JOIN u ON u.a = r.id) SELECT id, min(top) AS top FROM r GROUP BY id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, c.top AS component_id FROM n JOIN c ON c.id = n.doc_id
"""
