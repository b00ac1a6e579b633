"""Streams over sorted rows give the same rows however the rows are cut into batches, and those that a plain pass over whole groups gives."""

import random
from collections import Counter
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import pytest

from ondula.llm import ngram_join, passage_dedup


def batches(rows, names, size, kinds=None):
    types = [(kinds or {}).get(n, pa.int64()) for n in names]
    for at in range(0, len(rows), size):
        part = rows[at : at + size]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate(types)], names)


def listed(out):
    return Counter(tuple(r.values()) for b in out for r in b.to_pylist())


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_kinds_of_regions(size):
    draw = random.Random(5)
    rows = sorted((a, 10 * a + draw.randrange(3), draw.randrange(4), draw.randrange(50), draw.randrange(50)) for a in range(60) for _ in range(draw.randrange(1, 7)))
    want = Counter()
    for _, group in groupby(rows, key=lambda r: r[0]):
        kinds = [list(g) for _, g in groupby(group, key=lambda r: r[1])]
        for kind in kinds:
            if len(kind) > 1:
                want.update((*r[2:], True) for r in kind)
            if len(kinds) > 1:
                want[(*kind[0][2:], False)] += 1
    assert listed(passage_dedup._kinds(batches(rows, ["anchor", "region", "row_key", "first", "last"], size))) == want


@pytest.mark.parametrize("size", [1, 2, 3, 1000])
def test_repeated_windows_and_their_runs(size):
    draw = random.Random(6)
    rows = sorted((draw.randrange(80), draw.randrange(5), draw.randrange(60)) for _ in range(150))
    often = Counter(r[0] for r in rows)
    want = Counter(r[1:] for r in rows if often[r[0]] > 1)
    assert listed(passage_dedup._repeated(batches(rows, ["window", "row_key", "at"], size))) == want
    places = sorted(want.elements())
    runs = Counter()
    for key in range(5):
        own = sorted({at for k, at in places if k == key})
        for at in own:
            if at - 1 not in own:
                end = at
                while end + 1 in own:
                    end += 1
                runs[key, at, end] += 1
    assert listed(passage_dedup._joined(batches(places, ["row_key", "at"], size))) == runs


NAMES = ["token", "salt", "rep", "place", "n", "component"]


def entries(draw, lists=40, most=12):
    rows = []
    for token in range(lists):
        salt = draw.choice((-1, -1, -1, 0, 1))
        for rep in draw.sample(range(100), draw.randrange(1, most)):
            n = 20 + rep % 4
            rows.append((token, salt, rep, draw.randrange(5), n, rep // 9))
    return rows


@pytest.mark.parametrize("size", [1, 2, 3, 5, 1000])
def test_stars_of_lists(size):
    rows = sorted(entries(random.Random(7)), key=lambda r: (r[0], r[1], r[3], r[4], r[2]))
    want = Counter()
    for (token, salt), group in groupby(rows, key=lambda r: r[:2]):
        group = list(group)
        if len(group) < 2 and salt < 0:
            continue
        head = group[0]
        for k, r in enumerate(group):
            meets = r[2] != head[2] and r[5] != head[5] and bool(ngram_join._fits(r[4], r[3], head[4], head[3]))
            want[token, salt, r[2], r[3], r[4], head[2] if meets else None, len(group) > 2 or salt >= 0, k == 0] += 1
    assert listed(ngram_join._stars(batches(rows, NAMES, size))) == want


class _Task:
    @staticmethod
    def get():
        return _Task

    @staticmethod
    def partitionId():  # noqa: N802
        return 3


@pytest.mark.parametrize("size", [1, 2, 3, 5, 1000])
@pytest.mark.parametrize("block", [2, 4, 64])
def test_open_lists(size, block, monkeypatch):
    """Pairs inside blocks, and between the blocks that are handed on, are all pairs of a list that components, sizes, places and sketches leave."""
    monkeypatch.setattr(ngram_join, "TaskContext", _Task)
    draw = random.Random(8)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    small = {}
    for rep in range(100):
        own = base.copy()
        own[: rep % 3] = rng.integers(0, 2**63, rep % 3, dtype=np.uint64)
        small[rep] = ngram_join.folded(ngram_join.sketch(own if rep % 5 else rng.integers(0, 2**63, 30, dtype=np.uint64)), ngram_join.SMALL).tobytes()
    rows = sorted(entries(draw), key=lambda r: (r[0], r[1], r[5], r[3], r[4], r[2]))
    want = set()
    for _, group in groupby(rows, key=lambda r: r[:2]):
        for x, y in combinations(list(group), 2):
            apart = sum((a ^ b).bit_count() for a, b in zip(small[x[2]], small[y[2]]))
            if x[5] != y[5] and ngram_join._fits(x[4], x[3], y[4], y[3]) and 180 * apart <= 20 * (x[4] + y[4]):
                want.add((min(x[2], y[2]), max(x[2], y[2])))
    assert want
    found, blocks = set(), []
    for b in ngram_join._open(block)(batches([(*r, small[r[2]]) for r in rows], [*NAMES, "small"], size, {"small": pa.binary()})):
        for r in b.to_pylist():
            if r["a"] is not None:
                found.add((r["a"], r["b"]))
            else:
                blocks.append(r)
    assert len({r["block"] for r in blocks}) == len(blocks)
    columns = ("reps", "places", "ns", "components", "smalls")
    kinds = [pa.list_(pa.int64())] * 4 + [pa.binary()]
    # blocks of one part of a list only: other parts of it are other lists here
    salt_of = {(r[0], r[2]): r[1] for r in rows}
    for x, y in combinations(blocks, 2):
        if x["token"] == y["token"] and salt_of[x["token"], x["reps"][0]] == salt_of[y["token"], y["reps"][0]]:
            both = pa.RecordBatch.from_arrays([pa.array([z[c]], t) for z in (x, y) for c, t in zip(columns, kinds)], [f"{c}_{k}" for k in "ab" for c in columns])
            found |= {(r["a"], r["b"]) for b in ngram_join._across([both]) for r in b.to_pylist()}
    assert found == want
