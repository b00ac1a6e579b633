import numpy as np
import pytest

from ondula.functions import carried, kernels
from ondula.functions.duration import duration


@pytest.mark.parametrize(
    ("text", "rate", "samples"),
    [("10s", 1000, 10000), ("500ms", 1000, 500), ("2000us", 1000, 2), ("1h30m", 1, 5400), ("1s500ms200ms", 10, 17), ("2kHz", 10000, 5), ("0.5MHz", 1e6, 2), ("120BPM", 2, 1), ("", 100, 0), ("100", 100, 0), ("-5s", 10, 50)],
)
def test_durations(text, rate, samples):
    assert duration(text).count(rate) == samples


def test_unknown_unit():
    with pytest.raises(ValueError, match="unknown unit"):
        duration("5xyz")


def test_butterworth_matches_published_coefficients():
    b, a = kernels.butterworth(2, [10], "low", 100)
    assert np.allclose(b, [0.06745527, 0.13491055, 0.06745527]) and np.allclose(a, [1, -1.1429805, 0.4128016])


def test_zero_phase_keeps_a_slow_sine():
    x = np.sin(np.arange(400) / 20)
    y = kernels.zero_phase(*kernels.butterworth(2, [10], "low", 100), x)
    assert np.abs(y - x).max() < 0.02


@pytest.mark.parametrize("window", [5, 7, 8])
def test_savgol_keeps_polynomials(window):
    x = np.arange(40.0)
    smooth = kernels.savgol(x**2, window, 2)
    middle = slice(window, -window)
    shift = 0.0 if window % 2 else -0.5
    assert np.allclose(smooth[middle], (x + shift)[middle] ** 2) or np.allclose(smooth[middle], (x - shift)[middle] ** 2)


def test_peaks_with_plateau_distance_and_prominence():
    x = np.array([0, 1, 0, 2, 2, 0, 3, 1, 0.0])
    assert kernels.find_peaks(x).tolist() == [1, 3, 6]
    assert kernels.find_peaks(x, distance=3).tolist() == [3, 6]
    assert kernels.find_peaks(x, prominence=2).tolist() == [3, 6]
    assert kernels.find_peaks(x, height=3).tolist() == [6]


def test_prominence_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x = rng.integers(0, 9, 40).astype(float)
        peaks = kernels.local_maxima(x)
        for p, found, low, high in zip(peaks, *kernels.prominences(x, peaks), strict=True):
            a = max((i + 1 for i in range(p) if x[i] > x[p]), default=0)
            b = min((i for i in range(p + 1, len(x)) if x[i] > x[p]), default=len(x))
            assert found == x[p] - max(x[a : p + 1].min(), x[p:b].min())
            assert low == max(i for i in range(a, p + 1) if x[i] == x[a : p + 1].min()) and high == min(i for i in range(p, b) if x[i] == x[p:b].min())


def test_pchip_does_not_overshoot_and_meets_its_nodes():
    x, y = np.arange(6.0), np.array([0, 0, 1, 1, 5, 5.0])
    at = np.linspace(0, 5, 101)
    made = kernels.pchip(x, y, at)
    assert np.allclose(kernels.pchip(x, y, x), y) and made.min() > -1e-9 and made.max() < 5 + 1e-9 and (np.diff(made) > -1e-12).all()


def test_kalman_settles_on_a_line():
    assert abs(kernels.kalman(np.arange(200.0))[-1] - 199) < 0.01


def test_kalman_by_the_matrix_recursion():
    x = np.random.default_rng(2).normal(size=700).cumsum()
    move, noise = np.array([[1.0, 1], [0, 1]]), 0.1 * np.array([[0.25, 0.5], [0.5, 1]])
    state, spread, out = np.array([x[0], 0.0]), 1000 * np.eye(2), []
    for z in x:
        state, spread = move @ state, move @ spread @ move.T + noise
        gain = spread[:, 0] / (spread[0, 0] + 0.1)
        state, spread = state + gain * (z - state[0]), spread - np.outer(gain, spread[0])
        out.append(state[0])
    assert np.allclose(gain, [0.75, 0.5]) and np.allclose(kernels.kalman(x), out, rtol=0, atol=1e-9)


def test_filter_in_blocks_by_plain_recursion():
    b, a = kernels.butterworth(3, [4, 9], "bandpass", 50)
    x, z, out = np.random.default_rng(3).normal(size=1000), np.arange(len(a) - 1.0), []
    state = z.copy()
    for value in x:
        y = b[0] * value + state[0]
        state = np.append(state[1:], 0) + b[1:] * value - a[1:] * y
        out.append(y)
    own = carried.ZeroPhase(b, a).linear
    assert np.allclose(own.run(x, z)[0], out, rtol=0, atol=1e-8)


@pytest.mark.parametrize("degree", [2, 3])
def test_splines_keep_polynomials_of_their_degree(degree):
    x = np.array([0, 1, 2, 3.5, 5, 6, 8.0])
    at = np.linspace(0, 8, 41)
    assert np.allclose(kernels.spline(x, x**degree - 2 * x, at, degree), at**degree - 2 * at)
    y = np.random.default_rng(4).normal(size=7)
    assert np.allclose(kernels.spline(x, y, x, degree), y)


def test_cubic_smoothing_moves_steps_a_little():
    steps = np.repeat([10.0, 35, 20, 28], 6)
    for method, most in (("CUBIC", 0.01), ("QUADRATIC", 0.5)):
        moved = np.abs(kernels.smooth(steps, method) - steps).max()
        assert 0 < moved < most


def test_distance_by_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(50):
        x, far = rng.integers(0, 9, 60).astype(float), int(rng.integers(2, 9))
        left, kept = kernels.local_maxima(x).tolist(), []
        for p in sorted(left, key=lambda p: (x[p], p), reverse=True):
            if all(abs(p - q) >= far for q in kept):
                kept.append(p)
        assert kernels.find_peaks(x, distance=far).tolist() == sorted(kept)


def test_shape_of_three_bells():
    t = np.arange(300.0)
    wave = sum(np.exp(-(((t - c) / 20) ** 2)) for c in (75, 150, 225))
    made = kernels.shape(wave, 100, True, ["X", "Y", "PROMINENCE", "WIDTH_50"], 0.05)
    assert len(made) == 24 and np.allclose(made[:7], [0, 0.75, 1.12, 1.5, 1.87, 2.25, 2.99], atol=0.02)
    assert all(v != v for v in kernels.shape(wave, 100, False, ["X"], 0.05))


def plain_shape(y, rate, level):
    """Widths at half, prominences and decay by their definitions."""
    def maxima(v):
        return [i for i in range(1, len(v) - 1) if v[i - 1] < v[i] > v[i + 1]]

    def bases(v, p):
        left = right = p
        while left > 0 and v[left - 1] <= v[p]:
            left -= 1
        while right < len(v) - 1 and v[right + 1] <= v[p]:
            right += 1
        low, high = int(np.argmin(v[left : p + 1])), int(np.argmin(v[p : right + 1]))
        low = max(k for k in range(left, p + 1) if v[k] == v[left + low])  # the nearest of equals
        return low, p + high, v[p] - max(v[low], v[p + high])

    def width(v, p):
        low, high, prominence = bases(v, p)
        line = v[p] - prominence / 2
        i = p
        while i > low and v[i] > line:
            i -= 1
        a = i if v[i] >= line else i + (line - v[i]) / (v[i + 1] - v[i])
        j = p
        while j < high and v[j] > line:
            j += 1
        b = j if v[j] >= line else j - (line - v[j]) / (v[j - 1] - v[j])
        return b - a

    peaks = [p for p in maxima(y) if bases(y, p)[2] >= level]
    valleys = [p for p in maxima(-y) if bases(-y, p)[2] >= level and p >= peaks[0]]
    if len(peaks) < 3 or len(valleys) < 2:
        return None
    at = [(y, peaks[0]), (-y, valleys[0]), (y, peaks[1]), (-y, valleys[1]), (y, peaks[2])]
    decay = 0.0
    if len(peaks) > 3:
        p = peaks[3]
        end = next((k for k in range(p + 1, len(y)) if y[k] <= 0.3 * y[p]), len(y) - 1)
        decay = (y[p] - y[end]) / (end - p) if end > p else 0.0
    return [width(v, p) for v, p in at] + [bases(v, p)[2] for v, p in at] + [decay]


def test_widths_prominences_and_decay_by_definition():
    rng = np.random.default_rng(17)
    seen = 0
    for _ in range(200):
        y = np.cumsum(rng.normal(size=rng.integers(8, 60))) + 20
        got = kernels.shape(y, 100.0, True, ["WIDTH_50", "PROMINENCE", "DECAY"], 0.05)
        peaks = kernels.find_peaks(y, prominence=0.05)
        want = plain_shape(y, 100.0, 0.05) if len(peaks) else None
        if want is None:
            assert np.isnan(got).all()
        else:
            seen += 1
            assert np.allclose(got, want, rtol=0, atol=1e-9)
    assert seen > 50


def test_shapes_without_flat_peaks():
    """A plateau is a peak at its middle, or with flats off none: three peaks become two, and the cycle has no shape."""
    flat = np.array([0.0, 3, 0, 2, 2, 0, 3, 1, 2, 0])
    assert kernels.local_maxima(flat).tolist() == [1, 3, 6, 8] and kernels.local_maxima(flat, flats=False).tolist() == [1, 6, 8]
    assert kernels.find_peaks(flat, prominence=2, flats=False).tolist() == [1, 6]
    assert kernels.shape(flat, 10.0, True, ["X"], 0)[3] == 0.3 and kernels.shape(flat, 10.0, True, ["X"], 0, flats=False)[3] == 0.6
    assert all(v == v for v in kernels.shape(flat[:8], 10.0, True, ["AUC", "STATS_Y"], 0)) and all(v != v for v in kernels.shape(flat[:8], 10.0, True, ["AUC", "STATS_Y"], 0, flats=False))
