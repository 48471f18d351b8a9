"""Butterworth band-pass filters, designed here and run block by block."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.operators import blocks
from tideline.sources.files import written

#: Coefficients b0, b1, b2, a1, a2 of a second-order section.
Section = tuple[float, float, float, float, float]


def prewarp(f: float) -> float:
    """Analogue frequency of a normalised digital one (1 is the Nyquist frequency)."""
    return math.tan(math.pi * f / 2)


def least_order(passband: tuple[float, float], stopband: tuple[float, float], pass_loss: float, stop_loss: float) -> tuple[int, tuple[float, float]]:
    """Order and natural band of the smallest filter that loses at most ``pass_loss`` dB in one band and at least ``stop_loss`` outside the other."""
    p0, p1 = map(prewarp, passband)
    ratio = min(abs((prewarp(s) ** 2 - p0 * p1) / (prewarp(s) * (p1 - p0))) for s in stopband)
    ask, give = 10 ** (0.1 * stop_loss) - 1, 10 ** (0.1 * pass_loss) - 1
    order = max(1, math.ceil(math.log10(ask / give) / (2 * math.log10(ratio))))
    edge = give ** (-1 / (2 * order))
    width = (p1 - p0) * edge
    low = (-width + math.sqrt(width**2 + 4 * p0 * p1)) / 2
    return order, (2 / math.pi * math.atan(low), 2 / math.pi * math.atan(low + width))


def design(order: int, band: tuple[float, float]) -> list[Section]:
    """Second-order sections (b0, b1, b2, a1, a2) of a digital band-pass filter by the bilinear transform."""
    w0, w1 = map(prewarp, band)
    width, centre = w1 - w0, w0 * w1
    poles = []
    for k in range(order):
        q = np.exp(1j * math.pi * (2 * k + order + 1) / (2 * order)) * width / 2
        root = np.sqrt(q * q - centre + 0j)
        poles += [q + root, q - root]
    z = [(1 + p) / (1 - p) for p in poles]
    gain = width**order / np.prod([1 - p for p in poles]).real
    upper = sorted((x for x in z if x.imag > 1e-12), key=lambda x: (x.real, x.imag))
    real = sorted(x.real for x in z if abs(x.imag) <= 1e-12)
    pairs = [(-2 * x.real, abs(x) ** 2) for x in upper] + [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2], strict=True)]
    each = gain ** (1 / len(pairs))
    return [(each, 0.0, -each, a1, a2) for a1, a2 in pairs]


def transition(n: int, sections: list[Section]) -> np.ndarray:
    """The state after ``n`` samples without input, for each unit state."""
    step = free_response(1, sections)[1]
    return np.linalg.matrix_power(step, n)


def zero_state(x: np.ndarray, sections: list[Section], state: np.ndarray) -> np.ndarray:
    """The causal recursion down the columns of ``x``, all columns at once. ``state`` (two rows for each section) is changed to that after the last row."""
    out = np.empty_like(x)
    for i in range(len(x)):
        v = x[i]
        for j, (b0, b1, b2, a1, a2) in enumerate(sections):
            o = b0 * v + state[2 * j]
            state[2 * j], state[2 * j + 1] = b1 * v - a1 * o + state[2 * j + 1], b2 * v - a2 * o
            v = o
        out[i] = v
    return out


def free_response(n: int, sections: list[Section]) -> tuple[np.ndarray, np.ndarray]:
    """What ``n`` samples of no input give, for each unit state: the output by sample, and the state after them (the transition matrix)."""
    state = np.eye(2 * len(sections))
    out = zero_state(np.zeros((n, 2 * len(sections))), sections, state)
    return out, state


def run_sections(x: np.ndarray, sections: list[Section], state: np.ndarray | None = None, lanes: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """The causal recursion, section by section, from a state (zero if none): output and last state.

    The input is cut into ``lanes`` stretches that run side by side from zero; then their states are
    composed in order and the free response of each stretch's first state is added.
    """
    state = np.zeros(2 * len(sections)) if state is None else np.asarray(state, float)
    n = len(x) // lanes
    wide, rest = np.ascontiguousarray(x[: n * lanes].reshape(lanes, n).T, float), np.asarray(x[n * lanes :], float)
    parts = []
    if n:
        last = np.zeros((2 * len(sections), lanes))
        out = zero_state(wide, sections, last)
        free, step = free_response(n, sections)
        first = np.empty_like(last)
        for k in range(lanes):
            first[:, k] = state
            state = step @ state + last[:, k]
        parts.append((out + free @ first).T.ravel())
    if len(rest):
        column = state[:, None].copy()
        parts.append(zero_state(rest[:, None], sections, column)[:, 0])
        state = column[:, 0]
    return np.concatenate(parts) if parts else np.zeros(0), state


def bandpass(samples: DataFrame, passband: tuple[float, float], stopband: tuple[float, float], pass_loss: float, stop_loss: float, sample_rate: float, size: int = blocks.BLOCK) -> DataFrame:
    """Causal Butterworth band-pass of every channel: shot, ch_ix, sample_ix, t, value.

    A channel is a linear recurrence over blocks of ``size`` samples. Each block gives the state that it
    leaves behind when it begins from zero; the block states, a row for each block, are composed in
    order by the blocks' transition matrices; a second pass runs each block from its true first
    state. Both passes take one block at a time, however long the channel is.
    """
    nyquist = sample_rate / 2
    order, band = least_order(tuple(f / nyquist for f in passband), tuple(f / nyquist for f in stopband), pass_loss, stop_loss)
    sections = design(order, band)
    kinds = dict(samples.dtypes)
    head = f"shot {kinds['shot']}, ch_ix {kinds['ch_ix']}"
    packed = written(blocks.packed(samples, size))

    def leave(batches):
        for b in batches:
            x = list(blocks.arrays(b["value"]))
            states = np.array([run_sections(v, sections)[1] for v in x]).reshape(len(x), 2 * len(sections))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("shot", "ch_ix", "block")), pa.array([len(v) for v in x], pa.int64()), blocks.as_lists(states)], names=["shot", "ch_ix", "block", "n", "state"])

    def compose(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        steps: dict[int, np.ndarray] = {}
        state, first = np.zeros(2 * len(sections)), []
        for n, left in zip(table["n"].to_pylist(), blocks.as_matrix(table["state"]), strict=True):
            first.append(state)
            if n not in steps:
                steps[n] = transition(n, sections)
            state = steps[n] @ state + left
        return table.select(["shot", "ch_ix", "block"]).append_column("state", blocks.as_lists(np.array(first)))

    def run(batches):
        for b in batches:
            for i, (x, state) in enumerate(zip(blocks.arrays(b["value"]), blocks.arrays(b["state"]), strict=True)):
                own = b.slice(i, 1)
                out, _ = run_sections(x, sections, state)
                yield pa.RecordBatch.from_arrays(
                    [own["shot"].take(pa.array(np.zeros(len(x), int))), own["ch_ix"].take(pa.array(np.zeros(len(x), int))), own["sample_ix"].flatten(), own["t"].flatten(), pa.array(out)], names=["shot", "ch_ix", "sample_ix", "t", "value"]
                )

    left = packed.select("shot", "ch_ix", "block", "value").mapInArrow(leave, f"{head}, block long, n long, state array<double>")
    first = left.groupBy("shot", "ch_ix").applyInArrow(compose, f"{head}, block long, state array<double>")
    return blocks.beside(packed, first, "shot", "ch_ix", "block").mapInArrow(run, f"{head}, sample_ix long, t double, value double")
