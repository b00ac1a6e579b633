"""Steps over recordings in chunks against kernels of whole recordings."""

import itertools

import numpy as np
import pytest

from ondula.functions import kernels
from ondula.operators import chunks
from ondula.operators import samples as smp
from tests.helpers import recording, recordings

LENGTHS = [1000, 997, 40, 21, 20, 19]


def signals(lengths=LENGTHS, seed=11):
    rng = np.random.default_rng(seed)
    return [rng.normal(size=n).cumsum() + 3 * np.sin(np.arange(n) / 5) for n in lengths]


@pytest.fixture(params=[20, 7, 1 << 16])
def size(request, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK", request.param)
    return request.param


def channel(ds, name="Y"):
    """The channel of each recording."""
    rows = ds.samples.select("rec", "idx", name).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["rec"], r["idx"])):
        out.setdefault(r["rec"], []).append(np.nan if r[name] is None else r[name])
    return [np.array(out[k]) for k in sorted(out)]


@pytest.mark.parametrize(("power", "cut", "kind"), [(2, 2.0, "low"), (4, 1.0, "high"), (2, [1.0, 3.0], "bandpass")])
def test_butterworth_in_chunks(spark, size, power, cut, kind):
    x = [v for v in signals() if len(v) > 30]
    made = channel(smp.filtered(recordings(spark, x), "butterworth", "X", "Y", power=power, frequency=cut, ftype=kind))
    b, a = kernels.butterworth(power, cut, kind, 10.0)
    for v, y in zip(x, made, strict=True):
        assert np.allclose(y, kernels.zero_phase(b, a, v), rtol=0, atol=1e-9)


def plain_zero_phase(b, a, x):
    """The definition, sample by sample."""
    n = len(a)
    pad = 3 * n

    def once(v):
        state = np.linalg.solve(np.eye(n - 1) - np.vstack([-a[1:], np.eye(n - 2, n - 1)]).T, b[1:] - a[1:] * b[0]) * v[0]
        out = []
        for value in v:
            y = b[0] * value + state[0]
            state = np.append(state[1:], 0) + b[1:] * value - a[1:] * y
            out.append(y)
        return np.array(out)

    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    return once(once(wide)[::-1])[::-1][pad:-pad]


def test_zero_phase_by_its_definition():
    for x in signals([500, 31, 300]):
        b, a = kernels.butterworth(3, 2.0, "low", 10.0)
        assert np.allclose(kernels.zero_phase(b, a, x), plain_zero_phase(b, a, x), rtol=0, atol=1e-9)


def test_butterworth_leaves_recordings_with_gaps_and_refuses_short_ones(spark, size):
    x = signals([100])[0]
    x[55] = np.nan
    y = channel(smp.filtered(recording(spark, x), "butterworth", "X", "Y", power=2, frequency=2.0))[0]
    assert np.array_equal(y, x, equal_nan=True)
    with pytest.raises(Exception, match="too short"):
        smp.filtered(recording(spark, range(9)), "butterworth", "X", "Y", power=2, frequency=2.0).samples.collect()


def test_kalman_in_chunks(spark, size):
    x = signals()
    x[1][300] = np.nan
    made = channel(smp.filtered(recordings(spark, x), "kalman", "X", "Y"))
    for v, y in zip(x, made, strict=True):
        assert np.allclose(y, kernels.kalman(v), rtol=0, atol=1e-9, equal_nan=True)
    assert np.isfinite(made[1][:300]).all() and np.isnan(made[1][300:]).all()


@pytest.mark.parametrize("window", [5, 6, 16, 19])
def test_savgol_in_chunks(spark, size, window):
    x = signals()
    x[0][500] = np.nan
    made = channel(smp.filtered(recordings(spark, x), "savgol", "X", "Y", window=window, power=3))
    for v, y in zip(x, made, strict=True):
        assert np.allclose(y, kernels.savgol(v, window, 3), rtol=0, atol=1e-9, equal_nan=True)
    with pytest.raises(Exception, match="does not fit"):
        smp.filtered(recording(spark, range(4)), "savgol", "X", "Y", window=5, power=2).samples.collect()


def plain_resampled(x, markers, comments, new):
    """The rule for one recording: filled values, cubics, markers and comments."""
    n = len(x)
    filled = np.zeros(n)
    last = 0.0
    for i, v in enumerate(x):
        last = v if np.isfinite(v) else last
        filled[i] = last
    y = kernels.pchip(np.linspace(0, 1, n), filled, np.linspace(0, 1, new)) if n > 1 else np.full(new, filled[0])
    share = (new - 1) / (n - 1) if n > 1 else 0.0
    marks, notes = [[] for _ in range(new)], [""] * max(1, int(n * share))
    for i in range(n):
        marks[round(i * share)] = markers[i]
        if comments[i]:
            notes[max(0, min(round(i * share), len(notes) - 1))] = comments[i]
    return y, marks, (notes + [""] * new)[:new]


@pytest.mark.parametrize("rate", [25.0, 10.0, 3.0, 0.4])
def test_resampling_in_chunks(spark, size, rate):
    x = signals([500, 101, 40, 3, 2, 1])
    x[0][100:140] = np.nan
    x[1][:5] = np.nan
    x[2][7] = np.inf
    rng = np.random.default_rng(4)
    markers = [{i: ["M", "N"][: 1 + i % 2] for i in range(len(v)) if rng.random() < 0.3} for v in x]
    comments = [{i: f"C{i}" for i in range(len(v)) if rng.random() < 0.3} for v in x]
    ds = smp.resampled(recordings(spark, x, markers, comments), frequency=rate)
    assert "Pandas" not in ds.samples._jdf.queryExecution().toString() and "Arrow" not in ds.samples._jdf.queryExecution().toString()
    rows = sorted(ds.samples.collect(), key=lambda r: (r["rec"], r["idx"]))
    for k, v in enumerate(x):
        own = [r for r in rows if r["rec"] == k + 1]
        new = int((len(v) - 1) / 10.0 * rate) + 1
        y, marks, notes = plain_resampled(v, [markers[k].get(i, []) for i in range(len(v))], [comments[k].get(i, "") for i in range(len(v))], new)
        assert [r["idx"] for r in own] == list(range(new)) and {r["frequency"] for r in own} == {rate}
        assert np.allclose([r["X"] for r in own], y, rtol=0, atol=1e-9)
        assert [r["markers"] for r in own] == marks and [r["comment"] for r in own] == notes


def test_one_long_recording_is_many_groups(spark, monkeypatch):
    """A group is a chunk, however long its recording."""
    monkeypatch.setattr(chunks, "CHUNK", 50)
    seen = chunks.in_groups(chunks.chunked(recording(spark, range(5000)).samples), ("rec", "_chunk"), "idx", lambda g: g.select(["idx"]).slice(0, 1).append_column("n", [[g.num_rows]]), "idx long, n long")
    rows = seen.collect()
    assert len(rows) == 100 and {r["n"] for r in rows} == {50} and sorted(r["idx"] for r in rows) == list(range(0, 5000, 50))


def waves(seed=21):
    """Signals with plateaus, over chunk borders too, slopes, gaps and equal peaks."""
    rng = np.random.default_rng(seed)
    made = [rng.integers(0, 5, 400).astype(float), np.repeat(rng.integers(0, 9, 60), rng.integers(1, 30, 60)).astype(float), rng.normal(size=300).cumsum(), np.arange(100.0), -np.arange(100.0), np.full(90, 2.0)]
    made += [10 - np.arange(200) / 20 + np.arange(200) % 2, np.arange(200) / 20 + np.arange(200) % 2, np.tile([0.0, 3, 1, 3], 40), np.array([1.0]), np.array([1.0, 2, 1])]
    gaps = rng.normal(size=300).round(1)
    gaps[[0, 40, 41, 150, 299]] = np.nan
    return [*made, gaps]


@pytest.mark.parametrize("settings", [{}, {"prominence": 1.5}, {"difference": "600ms"}, {"difference": "2s", "height": 1.0, "prominence": 0.5}, {"form": "MIN", "prominence": 1.0, "difference": "400ms"}])
def test_peaks_in_chunks(spark, size, settings):
    x = waves()
    ds = smp.peaks(recordings(spark, x), "X", **settings)
    found = {}
    for r in ds.samples.filter("array_contains(markers, 'X')").select("rec", "idx").collect():
        found.setdefault(r["rec"], []).append(r["idx"])
    sign = -1 if settings.get("form") == "MIN" else 1
    distance = {"600ms": 6, "2s": 20, "400ms": 4}.get(settings.get("difference"), 1)
    for k, v in enumerate(x):
        want = plain_peaks(sign * v, settings.get("height", 0), distance, settings.get("prominence", 0))
        assert sorted(found.get(k + 1, [])) == want, k


@pytest.mark.parametrize("settings", [{}, {"prominence": 1.5}, {"difference": "600ms"}, {"difference": "2s", "height": 1.0, "prominence": 0.5}, {"form": "MIN", "prominence": 1.0, "difference": "400ms"}])
def test_peaks_without_flat_ones_in_chunks(spark, size, settings):
    """Plateaus are left out before the distance is looked at, and bound the prominence of others."""
    x = [*waves(), np.array([0.0, 4, 0, 9, 9, 2, 5, 1, 9, 9, 9, 0, 3, 0])]
    ds = smp.peaks(recordings(spark, x), "X", **settings, flats=False)
    found = {}
    for r in ds.samples.filter("array_contains(markers, 'X')").select("rec", "idx").collect():
        found.setdefault(r["rec"], []).append(r["idx"])
    sign = -1 if settings.get("form") == "MIN" else 1
    distance = {"600ms": 6, "2s": 20, "400ms": 4}.get(settings.get("difference"), 1)
    for k, v in enumerate(x):
        want = strict_peaks(sign * v, settings.get("height", 0), distance, settings.get("prominence", 0))
        assert sorted(found.get(k + 1, [])) == want, k


def strict_peaks(x, height, distance, prominence):
    """Samples above both neighbours, by the definition."""
    kept = []
    for p in sorted((p for p in range(1, len(x) - 1) if x[p - 1] < x[p] > x[p + 1] and (not height or x[p] >= height)), key=lambda p: (-x[p], -p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    lows = {p: [min(itertools.takewhile(lambda v, p=p: v <= x[p], side)) for side in (x[p::-1], x[p:])] for p in kept}
    return sorted(p for p in kept if not prominence or x[p] - max(lows[p]) >= prominence)


def plain_peaks(x, height, distance, prominence):
    """The definition, sample by sample."""
    peaks = []
    for i in range(1, len(x) - 1):
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            peaks.append((i + j) // 2)
    peaks = [p for p in peaks if not height or x[p] >= height]
    kept = []
    for p in sorted(peaks, key=lambda p: (-x[p], -p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)

    def low(p, step):
        least, i = x[p], p
        while 0 <= i < len(x) and x[i] <= x[p]:
            least, i = min(least, x[i]), i + step
        return least

    return sorted(p for p in kept if not prominence or x[p] - max(low(p, -1), low(p, 1)) >= prominence)
