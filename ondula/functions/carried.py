"""Linear filters in chunks: what a chunk adds to a state, states carried along a recording, and a chunk's output from its state.

A recursion s' = A s + b x is affine in its state, so a chunk of n samples maps a state s to A^n s + drive, where the drive is its end from an empty state. Drives are all
that has to be told to carry states over any number of chunks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


class Linear:
    """y[i] = c s[i] + d x[i] with s[i + 1] = a s[i] + b x[i], in blocks: only the states at block starts follow each other one by one."""

    def __init__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: float) -> None:
        self.a, self.b, self.c, self.d = a, b, c, d
        self._tables: dict[int, tuple] = {}

    def _table(self, length: int) -> tuple:
        if length not in self._tables:
            powers = [np.eye(len(self.a))]
            for _ in range(length):
                powers.append(powers[-1] @ self.a)
            answer = np.array([self.d, *(self.c @ powers[k] @ self.b for k in range(length - 1))])
            lag = np.subtract.outer(np.arange(length), np.arange(length))
            inside = np.where(lag >= 0, answer[np.abs(lag)], 0.0)
            drive = np.array([powers[length - 1 - k] @ self.b for k in range(length)])
            free = np.array([self.c @ powers[k] for k in range(length)])
            self._tables[length] = powers, inside.T, drive, free.T
        return self._tables[length]

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output and end state."""
        if not len(x):
            return np.zeros(0), np.asarray(state, float)
        length = 16
        while length < min(len(x), 256):
            length *= 2
        powers, inside, drive, free = self._table(length)
        blocks = np.append(x, np.zeros(-len(x) % length)).reshape(-1, length)
        driven = blocks @ drive
        states = np.empty((len(blocks), len(self.a)))
        for k in range(len(blocks)):
            states[k] = state
            if k < len(blocks) - 1:
                state = powers[length] @ state + driven[k]
        rest = len(x) - (len(blocks) - 1) * length
        end = powers[rest] @ states[-1] + blocks[-1, :rest] @ drive[length - rest :]
        return (blocks @ inside + states @ free).reshape(-1)[: len(x)], end

    def step(self, n: int) -> np.ndarray:
        """What n samples do to a state."""
        return np.linalg.matrix_power(self.a, n)


class Filter:
    """A filter whose chunks tell `summary`, get their part of `carried`, and `finish` from it."""

    def summary(self, start: int, x: np.ndarray) -> list[float]:
        raise NotImplementedError

    def carried(self, starts: list[int], sizes: list[int], told: list[np.ndarray]) -> list[np.ndarray]:
        raise NotImplementedError

    def finish(self, start: int, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        raise NotImplementedError


class ZeroPhase(Filter):
    """Forward and backward over an odd extension, from steady states. A recording with gaps stays as it is.

    The backward state after a chunk is affine in its own backward state and in the forward state, so both directions are carried in one pass.
    """

    def __init__(self, b: np.ndarray, a: np.ndarray) -> None:
        n = max(len(a), len(b))
        b, a = np.append(b, np.zeros(n - len(b))) / a[0], np.append(a, np.zeros(n - len(a))) / a[0]
        self.pad, self.order = 3 * n, n - 1
        step = np.eye(n - 1, k=1)
        step[:, 0] -= a[1:]
        self.linear = Linear(step, b[1:] - a[1:] * b[0], np.eye(n - 1)[0], b[0])
        companion = np.eye(n - 1) - np.vstack([-a[1:], np.eye(n - 2, n - 1)]).T
        self.steady = np.linalg.solve(companion, b[1:] - a[1:] * b[0])
        self._crossed: dict[int, np.ndarray] = {}

    def crossed(self, n: int) -> np.ndarray:
        """What a forward state adds to the backward state after n samples."""
        if n not in self._crossed:
            nothing = np.zeros(self.order)
            free = [self.linear.run(np.zeros(n), unit)[0][::-1] for unit in np.eye(self.order)]
            if len(self._crossed) > 64:
                self._crossed.clear()
            self._crossed[n] = np.array([self.linear.run(y, nothing)[1] for y in free]).T
        return self._crossed[n]

    def summary(self, start: int, x: np.ndarray) -> list[float]:
        """1 and two drives and the samples at either end; 0 if there are gaps."""
        if not np.isfinite(x).all():
            return [0.0]
        nothing = np.zeros(self.order)
        y, forward = self.linear.run(x, nothing)
        backward = self.linear.run(y[::-1], nothing)[1]
        return [1.0, *forward, *backward, *x[: self.pad + 1], *x[-self.pad - 1 :]]

    def carried(self, starts: list[int], sizes: list[int], told: list[np.ndarray]) -> list[np.ndarray]:
        if not all(t[0] for t in told):
            return [np.zeros(0)] * len(told)
        total, pad, k = sum(sizes), self.pad, self.order
        if total <= pad:
            raise ValueError(f"a recording of {total} samples is too short for this filter")
        held = [min(n, pad + 1) for n in sizes]
        head = np.concatenate([t[1 + 2 * k : 1 + 2 * k + h] for t, h in zip(told[: pad + 1], held, strict=False)])[: pad + 1]
        tail = np.concatenate([t[len(t) - h :] for t, h in zip(told[-pad - 1 :], held[-pad - 1 :], strict=True)])[-pad - 1 :]
        lead = 2 * head[0] - head[pad:0:-1]
        forward = [self.linear.run(lead, self.steady * lead[0])[1]]
        for n, t in zip(sizes, told, strict=True):
            forward.append(self.linear.step(n) @ forward[-1] + t[1 : 1 + k])
        trail = self.linear.run(2 * tail[-1] - tail[-2::-1], forward[-1])[0][::-1]
        state = self.linear.run(trail, self.steady * trail[0])[1]
        out = [np.zeros(0)] * len(told)
        for i in range(len(told) - 1, -1, -1):
            out[i] = np.concatenate([forward[i], state])
            if i:
                state = self.linear.step(sizes[i]) @ state + told[i][1 + k : 1 + 2 * k] + self.crossed(sizes[i]) @ forward[i]
        return out

    def finish(self, start: int, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        if not len(state):
            return x
        y = self.linear.run(x, state[: self.order])[0]
        return self.linear.run(y[::-1], state[self.order :])[0][::-1]


class Kalman(Filter):
    """Positions of a constant-velocity model with unit steps and white-noise acceleration of variance q.

    The gains depend on the place only; once they have settled, what is left is a linear filter. From a gap on there is no position.
    """

    def __init__(self, q: float = 0.1, r: float = 0.1, start: float = 1000.0) -> None:
        p00, p01, p11 = start, 0.0, start
        self.gains: list[tuple[float, float]] = []
        while True:
            p00, p01, p11 = p00 + 2 * p01 + p11 + q / 4, p01 + p11 + q / 2, p11 + q
            k0, k1 = p00 / (p00 + r), p01 / (p00 + r)
            if self.gains and abs(k0 - self.gains[-1][0]) + abs(k1 - self.gains[-1][1]) < 1e-15:
                break
            self.gains.append((k0, k1))
            p00, p01, p11 = (1 - k0) * p00, (1 - k0) * p01, p11 - k1 * p01
        step = np.array([[1 - k0, 1 - k0], [-k1, 1 - k1]])
        self.linear = Linear(step, np.array([k0, k1]), step[0], k0)

    def run(self, start: int, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap = np.flatnonzero(~np.isfinite(x))
        known = x[: gap[0]] if len(gap) else x
        position, speed = float(state[0]), float(state[1])
        first = []
        for (k0, k1), value in zip(self.gains[start:], known.tolist(), strict=False):
            position += speed
            miss = value - position
            position, speed = position + k0 * miss, speed + k1 * miss
            first.append(position)
        rest, end = self.linear.run(known[len(first) :], np.array([position, speed]))
        if len(gap):
            return np.concatenate([first, rest, np.full(len(x) - len(known), np.nan)]), np.full(2, np.nan)
        return np.concatenate([first, rest]), end

    def step(self, start: int, n: int) -> np.ndarray:
        out = np.eye(2)
        settling = self.gains[start : start + n]
        for k0, k1 in settling:
            out = np.array([[1 - k0, 1 - k0], [-k1, 1 - k1]]) @ out
        return self.linear.step(n - len(settling)) @ out

    def summary(self, start: int, x: np.ndarray) -> list[float]:
        return [float(x[0]), *self.run(start, x, np.zeros(2))[1]]

    def carried(self, starts: list[int], sizes: list[int], told: list[np.ndarray]) -> list[np.ndarray]:
        states = [np.array([told[0][0], 0.0])]
        for start, n, t in zip(starts, sizes, told, strict=True):
            states.append(self.step(start, n) @ states[-1] + t[1:])
        return states[:-1]

    def finish(self, start: int, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        return self.run(start, x, state)[0]


@lru_cache(maxsize=64)
def zero_phase(b: tuple[float, ...], a: tuple[float, ...]) -> ZeroPhase:
    """A worker keeps its filters with their tables."""
    return ZeroPhase(np.array(b), np.array(a))


@lru_cache(maxsize=8)
def kalman() -> Kalman:
    return Kalman()
