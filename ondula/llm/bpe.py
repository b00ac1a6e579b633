"""Byte-level BPE encoding and decoding by batched merge rounds in NumPy.

Symbols of many words lie in one flat array with their word's number. In each round all adjacent pairs are looked up by binary search over the sorted pair
keys; in every word the pair of lowest rank is merged wherever it occurs, left to right, and the array is compacted. Rounds go on until no word has
a pair left. A word takes as many rounds as it has distinct merges, so a batch takes about as many rounds as its longest word; words of more than LONG bytes, as
in scripts without spaces, would make each round a scan of little use and are merged one by one with a heap of their pairs, to the same ids.

Words come from the byte-level pattern; distinct chunks are encoded once per worker (tokens.ChunkEncoder). Added special tokens found in a text
become their ids, as in the tokenizers library. Decoding maps ids back to bytes and reads them as UTF-8, with U+FFFD for broken sequences.

Defined cases: a null or empty text has no ids and decodes to the empty text. Equal rows get equal results. An empty table gives no rows. A very long text is encoded
in slices of words, so memory follows the text and not its square.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ondula.llm.common import arrow_map, documents, slices
from ondula.llm.tokens import Ragged, default_path, worker_encoder

#: The published split pattern of this kind of vocabulary (fixed value).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Symbols that one run of merge rounds holds.
BATCH_SYMBOLS = 1 << 20
LONG = 1024


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int]) -> None:
        alphabet = byte_alphabet()
        self.bytes_of = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items()} | {i: t.encode() for t, i in added.items()}
        self.first = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.first[b] = vocab[c]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made
        self.added = added
        self.known: dict[int, int] | None = None
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]

    @classmethod
    def from_file(cls, path: str) -> ByteBpe:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        return cls(spec["model"]["vocab"], merges, {x["content"]: x["id"] for x in spec["added_tokens"]})

    def merge(self, words: list[bytes]) -> Ragged:
        """Ids of many words at once."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_owner = [], []
        none = len(self.keys)
        while len(symbols) > 1:
            pairs = (symbols[:-1] << 32) | symbols[1:]
            at = np.searchsorted(self.keys, pairs)
            at[at == none] = 0
            rank = np.where((self.keys[at] == pairs) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(np.append(rank, none), starts)
            best_of = np.repeat(best, np.diff(np.append(starts, len(symbols))))
            live = best_of < none
            if not live.all():  # finished words leave the array
                done_symbols.append(symbols[~live])
                done_owner.append(owner[~live])
                symbols, owner, best_of, rank = symbols[live], owner[live], best_of[live], np.append(rank, none)[live][:-1]
            if not len(symbols):
                break
            hit = rank == best_of[:-1]
            # of overlapping hits (a run of one repeated symbol) every second one counts, from the left
            index = np.flatnonzero(hit)
            if len(index) > 1:
                new_run = np.concatenate([[True], np.diff(index) != 1])
                run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(index)), 0))
                index = index[(np.arange(len(index)) - run_start) % 2 == 0]
            symbols[index] = self.made[rank[index]]
            keep = np.ones(len(symbols), bool)
            keep[index + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        symbols, owner = np.concatenate([*done_symbols, symbols]), np.concatenate([*done_owner, owner])
        order = np.argsort(owner, kind="stable")
        return Ragged(symbols[order].astype(np.uint32), np.bincount(owner, minlength=len(words)))

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word: the pair of lowest rank, leftmost first, from a heap; neighbours are linked by place."""
        if self.known is None:
            self.known = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        symbols, made, known = self.first[np.frombuffer(word, np.uint8)].tolist(), self.made.tolist(), self.known
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank, i) for i in range(n - 1) if (rank := known.get(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n or known.get(symbols[i] << 32 | symbols[j]) != rank:
                continue  # one of the two has gone into another symbol
            symbols[i], symbols[j], after[i] = made[rank], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (new := known.get(symbols[i] << 32 | symbols[after[i]])) is not None:
                    heapq.heappush(heap, (new, i))
            if before[i] >= 0 and (new := known.get(symbols[before[i]] << 32 | symbols[i])) is not None:
                heapq.heappush(heap, (new, before[i]))
        return np.array([x for x in symbols if x >= 0], np.uint32)

    def encode_chunks(self, chunks: list[str]) -> Ragged:
        """Ids of each chunk: split by the pattern, distinct words merged together."""
        number: dict[str, int] = {}
        parts, counts = [], []
        for chunk in chunks:
            sections = self.split_added.split(chunk) if self.split_added and "<|" in chunk else [chunk]
            before = len(parts)
            for section in sections:
                if section in self.added:
                    parts.append(-1 - self.added[section])
                elif section:
                    parts.extend([number.setdefault(w, len(number)) for w in PATTERN.findall(section)])
            counts.append(len(parts) - before)
        made = [Ragged(np.zeros(0, np.uint32), np.zeros(0, np.int64))]
        group, held = [], 0
        for word in number:
            data = word.encode()
            if len(data) > LONG:
                if group:
                    made.append(self.merge(group))
                    group, held = [], 0
                ids = self.merge_long(data)
                made.append(Ragged(ids, np.array([len(ids)])))
                continue
            group.append(data)
            held += len(data)
            if held >= BATCH_SYMBOLS:
                made.append(self.merge(group))
                group, held = [], 0
        if group:
            made.append(self.merge(group))
        specials = sorted({p for p in parts if p < 0})
        flat = np.concatenate([*(m.flat for m in made), np.array([-1 - p for p in specials], np.uint32)])
        lengths = np.concatenate([*(m.lengths for m in made), np.ones(len(specials), np.int64)])
        place = {p: len(number) + i for i, p in enumerate(specials)}
        picked = np.array([place[p] if p < 0 else p for p in parts], np.int64)
        return Ragged(flat, lengths).take(picked, np.cumsum(counts))

    def decode(self, ids) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_text_batches(path: str, with_ids: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder("merge", path)
        coder = encoder.encode.__self__
        digits = [str(i) for i in range(len(coder.table))]
        for batch in slices(batches):
            ids, sizes = encoder([t or "" for t in batch.column("text").to_pylist()])
            ends = np.cumsum(sizes)
            out = []
            for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
                own = ids[end - size : end].tolist()
                if with_ids:
                    out.append((own, coder.decode(own)))
                else:
                    joined = ",".join(map(digits.__getitem__, own))
                    out.append((hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(coder.decode(own).encode()).hexdigest()))
            first, second = zip(*out, strict=True)
            kinds = (pa.list_(pa.int32()), pa.string()) if with_ids else (pa.string(), pa.string())
            names = ["doc_id", "n_tokens", *(("ids", "decoded") if with_ids else ("ids_sha256", "decoded_sha256"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(first, kinds[0]), pa.array(second, kinds[1])], names)

    return work


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(chosen, encode_text_batches(path or default_path("byte_bpe_50k.json"), True), "doc_id long, n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and SHA-256 digests of the ids and of the text decoded from them, without moving the ids."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(chosen, encode_text_batches(path or default_path("byte_bpe_50k.json"), False), SCHEMA)


def op9(spark, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
