"""Public tokenizers applied to columns of text: chunk caches around the tokenizers library, with flat NumPy id arrays.

A text is cut at single spaces into chunks whose ids do not depend on their neighbours; each distinct chunk is encoded once and
looked up afterwards. Texts in which a space stands between other white space are encoded whole, so ids always equal those of the library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from ondula.llm.common import keep

#: A worker forgets its cached chunks beyond this many.
CACHE_CHUNKS = 400_000
#: Texts that go to the library in one call.
CALL_TEXTS = 2_000
#: A space between white space: there a cut at the space would change the ids.
_UNSAFE = re.compile(r"\s \s|\s \Z|<\|")
#: Lower case or normal form may take more than one character, or there may be an added token.
_NOT_BY_CHARACTER = re.compile("[\u0100-\U0010ffff]|<\\|")


class Ragged:
    """Lists of ids as one flat array."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.flat, self.lengths, self.ends = flat, lengths, np.cumsum(lengths)

    def __len__(self) -> int:
        return len(self.lengths)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.ends[i] - self.lengths[i] : self.ends[i]]

    def take(self, picked: np.ndarray, bounds: np.ndarray) -> Ragged:
        """Lists made of the picked lists, the i-th of those before bounds[i] and after its predecessor's."""
        size = self.lengths[picked]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.ends[picked] - ends, size) + np.arange(total)]
        return Ragged(ids, np.diff(np.concatenate([[0], ends])[bounds], prepend=0))


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def library_ids(path: str) -> Callable[[list[str]], Ragged]:
    """Encodes a list of strings by the tokenizers library."""
    tokenizer = load(path)

    def encode(texts: list[str]) -> Ragged:
        ids = []
        for at in range(0, len(texts), CALL_TEXTS):  # the library's results are large beside their ids
            ids += [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts[at : at + CALL_TEXTS], add_special_tokens=False)]
        return Ragged(np.concatenate([np.zeros(0, np.uint32), *ids]), np.fromiter(map(len, ids), np.int64, len(ids)))

    return encode


class _Seen(dict):
    """Chunk -> number, in order of first sight."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = number = len(self)
        self.new.append(chunk)
        return number


class WordPieces:
    """The library's ids for chunks under a vocabulary with word ends: distinct lower-cased words go to the library many to a call.

    The words are cut and lower-cased here, so the library gets them without its normaliser and splits at spaces only. Every word ends in exactly one id that
    carries the word end, so a call's ids can be cut into words again. Words are kept for later calls, until there are more than `limit`. Chunks with characters from
    U+0100 on, where lower case and normal form are not by character, and chunks that may hold added tokens go to the library as they are.
    """

    CALL_WORDS = 20_000

    def __init__(self, path: str, limit: int = CACHE_CHUNKS) -> None:
        from tokenizers import pre_tokenizers

        self.whole, self.words, self.limit = load(path), load(path), limit
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        vocab = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 8, bool)
        for token, number in vocab.items():
            self.ends[number] = token.endswith(spec["model"]["end_of_word_suffix"])
        self.reset()

    def reset(self) -> None:
        self.seen = _Seen()
        self.known = Ragged(np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def __call__(self, chunks: list[str]) -> Ragged:
        if len(self.seen) > self.limit:
            self.reset()
        number = self.seen.__getitem__
        parts: list[int] = []
        ends = np.zeros(len(chunks), np.int64)
        other: list[str] = []
        for i, chunk in enumerate(chunks):
            if _NOT_BY_CHARACTER.search(chunk):
                other.append(chunk)
                parts.append(-len(other))
            else:
                low = chunk.lower()
                if low.isalpha():
                    parts.append(number(low))
                else:
                    parts += map(number, self.pattern.findall(low))
            ends[i] = len(parts)
        self._learn()
        rest = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast(other, add_special_tokens=False)] if other else []
        lengths = np.concatenate([self.known.lengths, np.fromiter(map(len, rest), np.int64, len(rest))])
        picked = np.array(parts, np.int64)
        return Ragged(np.concatenate([self.known.flat, *rest]), lengths).take(np.where(picked < 0, len(self.known) - 1 - picked, picked), ends)

    def _learn(self) -> None:
        new, self.seen.new = self.seen.new, []
        found = [np.zeros(0, np.uint32)]
        for at in range(0, len(new), self.CALL_WORDS):
            text = " ".join(new[at : at + self.CALL_WORDS])
            found.append(np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32))
        flat = np.concatenate(found)
        cuts = np.flatnonzero(self.ends[flat]) + 1
        if len(cuts) != len(new):
            self.reset()
            raise ValueError("the vocabulary does not end every word")
        self.known = Ragged(np.concatenate([self.known.flat, flat]), np.concatenate([self.known.lengths, np.diff(cuts, prepend=0)]))


class ChunkEncoder:
    """Encodes texts chunk by chunk. `encode` turns a list of strings into their ids; `spaced` says that a chunk keeps the space before it."""

    def __init__(self, encode: Callable[[list[str]], Ragged], spaced: bool, limit: int = CACHE_CHUNKS) -> None:
        self.encode, self.spaced, self.limit = encode, spaced, limit
        self.reset()

    def reset(self) -> None:
        self.seen = _Seen()
        self.known = Ragged(np.zeros(0, np.uint32), np.zeros(0, np.int64))
        self.uses = np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keeps the chunks that came twice or more since they were last counted, and halves their counts."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > self.limit // 2:
            kept = np.sort(kept[np.argsort(self.uses[kept], kind="stable")[-self.limit // 2 :]])
        chunks = list(self.seen)
        uses, self.known = self.uses[kept], self.known.take(kept, np.arange(1, len(kept) + 1))
        self.seen = _Seen()
        self.seen.update((chunks[k], i) for i, k in enumerate(kept.tolist()))
        self.uses = uses // 2

    def chunks(self, text: str) -> list[str]:
        if self.spaced:
            if _UNSAFE.search(text):
                return [text]
            first, *rest = text.split(" ")
            return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]
        return [text] if "<|" in text else text.split()

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all chunks, and how many of them each text has."""
        numbers, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = self.chunks(text)
            counts[i] = len(parts)
            numbers.extend(map(self.seen.__getitem__, parts))
        return np.array(numbers, np.int64), counts

    def _word_numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same where white space is dropped: Arrow cuts at ASCII white space, and each distinct chunk is looked up once."""
        whole = pc.match_substring(texts, "<|")  # an added token may hold white space
        parts = pc.ascii_split_whitespace(pc.if_else(whole, "a", texts))
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = parts.flatten().dictionary_encode()
        distinct = flat.dictionary.to_numpy(zero_copy_only=False)  # faster than to_pylist
        numbers = np.fromiter(map(self.seen.__getitem__, distinct), np.int64, len(distinct))[flat.indices.to_numpy()]
        rows = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        for at, text in zip((np.cumsum(counts) - counts)[rows].tolist(), texts.take(pa.array(rows)).to_pylist(), strict=True):
            numbers[at] = self.seen[text]
        return numbers, counts

    def __call__(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text."""
        if len(self.seen) > self.limit:
            self.forget()
        if self.spaced:
            picked, counts = self._numbers([t or "" for t in texts.to_pylist()] if isinstance(texts, pa.Array) else texts)
        else:
            picked, counts = self._word_numbers(pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), ""))
        self._learn()
        self.uses += np.bincount(picked, minlength=len(self.uses))
        made = self.known.take(picked, np.cumsum(counts))
        return made.flat, made.lengths

    def _learn(self) -> None:
        new, self.seen.new = self.seen.new, []
        if not new:
            return
        found = self.encode(new)
        self.known = Ragged(np.concatenate([self.known.flat, found.flat]), np.concatenate([self.known.lengths, found.lengths]))
        self.uses = np.append(self.uses, np.zeros(len(new), np.int64))


def worker_encoder(kind: str, path: str) -> ChunkEncoder:
    """This worker's encoder. kind: byte (spaces kept), word (white space dropped) or merge (rounds in NumPy)."""

    def make() -> ChunkEncoder:
        if kind == "merge":
            from ondula.llm.bpe import ByteBpe

            encode = ByteBpe.from_file(path).encode_chunks
        else:
            encode = WordPieces(path) if kind == "word" else library_ids(path)
        return ChunkEncoder(encode, spaced=kind != "word")

    return keep(("encoder", kind, path), make)


def added_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}


def rank_encoder(path: str):
    """A byte-level vocabulary file as a tiktoken encoder: the same merges and ids, several times as fast on whole texts."""
    import tiktoken

    from ondula.llm.bpe import PATTERN, byte_alphabet

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in token): number for token, number in spec["model"]["vocab"].items()}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN.pattern, mergeable_ranks=ranks, special_tokens=special)
