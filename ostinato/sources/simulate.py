"""Synthetic series of known rhythm: fifteen scenarios, and populations of mixed kinds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TWO_PI = 2 * np.pi


def _cos(t: np.ndarray, period: float, a: float, phase: float = 0.0) -> np.ndarray:
    return a * np.cos(TWO_PI * t / period - phase)


def _saw(t, rng):
    return 2 * (2 * np.mod(t / 24, 1) - 1)


def _triangle(t: np.ndarray, rise: float) -> np.ndarray:
    p = np.mod(t / 12, 1)
    return np.where(p < rise, 2 * p / rise - 1, 1 - 2 * (p - rise) / (1 - rise))


def _drift(t, rng):
    period = 11 + 2 * np.arange(len(t)) / max(len(t) - 1, 1)
    dt = np.diff(t, prepend=t[0] - (t[1] - t[0] if len(t) > 1 else 0))
    return 1.5 * np.cos(np.cumsum(TWO_PI * dt / period))


#: Name to the clean signal about the mean, the noise's spread, and whether a half-period rhythm is independent, or harmonic.
SCENARIOS: dict[str, tuple[Callable, float, bool, bool]] = {
    "pure_circadian": (lambda t, r: _cos(t, 24, 2), 0.5, False, False),
    "pure_ultradian": (lambda t, r: _cos(t, 12, 1.5), 0.5, True, False),
    "independent_superposition": (lambda t, r: _cos(t, 24, 2) + _cos(t, 11.8, 1.5, r.uniform(0, TWO_PI)), 0.5, True, False),
    "sawtooth_harmonic": (_saw, 0.5, False, True),
    "peaked_harmonic": (lambda t, r: sum(_cos(t, 24 / k, 2 * 0.2 ** (k - 1)) for k in range(1, 6)), 0.5, False, True),
    "independent_multi_ultradian": (lambda t, r: _cos(t, 12, 1.5) + _cos(t, 8, 1.0, 0.3), 0.5, True, False),
    "damped_ultradian": (lambda t, r: np.exp(-0.02 * t) * _cos(t, 12, 2), 0.5, True, False),
    "asymmetric_ultradian": (lambda t, r: 1.5 * _triangle(t, 0.3), 0.5, True, False),
    "pure_noise": (lambda t, r: 0 * t, 1.0, False, False),
    "trend_noise": (lambda t, r: 0.05 * t, 0.5, False, False),
    "low_snr_ultradian": (lambda t, r: _cos(t, 12, 0.5), 1.0, True, False),
    "drifting_ultradian": (_drift, 0.5, True, False),
    "square_wave_harmonic": (lambda t, r: np.where(np.mod(t / 24, 1) < 0.35, 2.0, -2.0), 0.5, False, True),
    "bimodal_circadian": (lambda t, r: _cos(t, 24, 2) + _cos(t, 12, 0.8), 0.5, False, True),
    "pulse_circadian": (lambda t, r: 3 * np.exp(-0.5 * ((np.mod(t / 24, 1) - 0.5) / (4 / 24)) ** 2), 0.5, False, True),
}
NAMES = list(SCENARIOS)


def one(name: str, t: np.ndarray, seed: int, noise: float | None = None, mean: float = 5.0) -> np.ndarray:
    """A series of a scenario; the generator draws the scenario's own numbers before the noise."""
    clean, sd, *_ = SCENARIOS[name]
    rng = np.random.RandomState(seed)
    return mean + clean(t, rng) + rng.normal(0, sd if noise is None else noise, len(t))


SCHEMA = "series_id string, t array<double>, y array<double>, scenario string, replicate int, has_independent_12h boolean, has_harmonic_12h boolean"


def scenarios(spark: SparkSession, replicates: int, points: int = 24, step: float = 2.0, seed: int = 42, noise: float | None = None) -> DataFrame:
    """All scenarios, each with its replicates: every series has a seed of its own, so rows don't depend on their partition."""
    t = np.arange(points) * step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks = batch.column(0).to_pylist()
            at = [(NAMES[k % len(NAMES)], k % len(NAMES), k // len(NAMES)) for k in ks]
            ys = [one(n, t, seed + 100 * i + r, noise).tolist() for n, i, r in at]
            flags = [SCENARIOS[n][2:] for n, _, _ in at]
            cols = [pa.array([f"{n}_{r}" for n, _, r in at]), pa.array([t.tolist()] * len(at), pa.list_(pa.float64())), pa.array(ys, pa.list_(pa.float64())), pa.array([n for n, _, _ in at]), pa.array([r for _, _, r in at], pa.int32()), pa.array([f[0] for f in flags]), pa.array([f[1] for f in flags])]
            yield pa.RecordBatch.from_arrays(cols, ["series_id", "t", "y", "scenario", "replicate", "has_independent_12h", "has_harmonic_12h"])

    return spark.range(replicates * len(NAMES)).mapInArrow(run, SCHEMA)


#: Shares of a population's kinds. Fixed values.
SHARES = {"noise": 0.4, "circadian": 0.25, "independent_12h": 0.1, "harmonic_12h": 0.1, "ultradian_8h": 0.05, "damped": 0.05, "other": 0.05}


def population(spark: SparkSession, n: int, points: int = 24, step: float = 2.0, seed: int = 42) -> DataFrame:
    """series_id, t, y, kind: series of seven kinds with random amplitudes, phases and periods, kinds dealt by a hash of the number."""
    t, names, edges = np.arange(points) * step, list(SHARES), np.cumsum(list(SHARES.values()))

    def make(k: int) -> tuple[str, np.ndarray]:
        r = np.random.RandomState((seed * 1_000_003 + k) % 2**31)
        kind = names[int(np.searchsorted(edges, r.uniform() * edges[-1]))]
        a, p = r.uniform(0.8, 2.5), r.uniform(0, TWO_PI)
        y = {
            "noise": lambda: 0 * t,
            "circadian": lambda: _cos(t, 24, a, p),
            "independent_12h": lambda: _cos(t, 24, r.uniform(0.5, 2), r.uniform(0, TWO_PI)) + _cos(t, r.uniform(11, 13), a, p),
            "harmonic_12h": lambda: sum(_cos(t, 24 / i, a / i, i * p) for i in (1, 2, 3)),
            "ultradian_8h": lambda: _cos(t, 8, a, p),
            "damped": lambda: np.exp(-r.uniform(0.01, 0.05) * t) * _cos(t, 12, a, p),
            "other": lambda: a * np.where(np.mod(t / 24 + p / TWO_PI, 1) < 0.35, 1.0, -1.0),
        }[kind]()
        return kind, r.uniform(3, 8) + y + r.normal(0, r.uniform(0.3, 0.8), len(t))

    def run(batches):
        for batch in batches:
            rows = [make(k) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f"g{k}" for k in batch.column(0).to_pylist()]), pa.array([t.tolist()] * len(rows), pa.list_(pa.float64())), pa.array([y.tolist() for _, y in rows], pa.list_(pa.float64())), pa.array([k for k, _ in rows])], ["series_id", "t", "y", "kind"])

    return spark.range(n).mapInArrow(run, "series_id string, t array<double>, y array<double>, kind string")
