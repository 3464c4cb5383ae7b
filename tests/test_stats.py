"""Closed forms against integration and enumeration."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostinato.functions import kernels as K
from ostinato.functions import stats as S


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def f_sf(x, d1, d2):
    grid = np.linspace(0, 1, 2_000_001)[1:-1]
    u = grid * d2 / (d2 + d1 * x)  # incomplete beta over the tail
    c = math.exp(math.lgamma((d1 + d2) / 2) - math.lgamma(d1 / 2) - math.lgamma(d2 / 2))
    y = c * u ** (d2 / 2 - 1) * (1 - u) ** (d1 / 2 - 1)
    return float(((y[1:] + y[:-1]) / 2 * np.diff(u)).sum())


def test_f_and_t(spark):
    r = one(spark, S.f_sf_2(F.lit(10.0), F.lit(6.0), F.lit(20.0)), S.f_sf_even(F.lit(2.5), F.lit(6.0), F.lit(41.0)), S.f_sf_1(F.lit(4.2), F.lit(19)), S.f_sf_1(F.lit(4.2), F.lit(18)), S.f_sf_2(F.lit(1.0), F.lit(0.0), F.lit(5.0)))
    assert r[0] == pytest.approx(0.6**10)
    assert r[1] == pytest.approx(f_sf(2.5, 6, 41), abs=1e-6)
    assert r[2] == pytest.approx(K.f1_p(4.2, 19)) and r[3] == pytest.approx(K.f1_p(4.2, 18))
    assert r[2] == pytest.approx(0.05448, abs=2e-4)
    assert r[4] == 0.0


def test_erfc(spark):
    for x in (0.0, 0.3, 1.0, 2.4, 2.6, 4.0):
        assert one(spark, S.erfc(F.lit(x)))[0] == pytest.approx(math.erfc(x), rel=1e-9, abs=1e-14)


def test_exact_tests(spark):
    a, b, c, d = 8, 2, 1, 5
    total = math.comb(16, 9)
    pmf = {k: math.comb(10, k) * math.comb(6, 9 - k) / total for k in range(3, 10)}
    r = one(spark, S.fisher_two_sided(*map(F.lit, (a, b, c, d))), S.hypergeometric_sf(F.lit(8), F.lit(16), F.lit(9), F.lit(10)))
    assert r[0] == pytest.approx(sum(p for p in pmf.values() if p <= pmf[8] * (1 + 1e-7)))
    assert r[1] == pytest.approx(pmf[8] + pmf[9])


def test_cauchy(spark):
    r = one(spark, S.cauchy_combine(F.array(F.lit(0.01), F.lit(0.9))), S.cauchy_combine(F.array(F.lit(0.7), F.lit(0.9))), S.cauchy_combine(F.array(F.lit(0.03), F.lit(None).cast("double"))))
    assert r[0] == pytest.approx(0.01) and r[1] == 0.5 and r[2] == pytest.approx(0.03)


def test_kendall_exact():
    from itertools import permutations

    y = np.array([1.0, 4, 2, 3, 5])
    tau, p = K.kendall(y, np.arange(5.0))
    s = lambda q: sum(np.sign(q[j] - q[i]) for i in range(5) for j in range(i + 1, 5))
    seen = abs(s(y))
    assert tau[0] == pytest.approx(s(y) / 10)
    assert p[0] == pytest.approx(np.mean([abs(s(q)) >= seen for q in permutations(range(5))]))


def test_free_periods_and_damping():
    t = np.arange(0, 48.0)
    y = 2 * np.cos(2 * np.pi * t / 24) + 1.5 * np.cos(2 * np.pi * t / 11.6 + 1)
    p, rss = K.free_periods(t, y, [24.0, 12.0, 8.0])
    assert p[0][1] == pytest.approx(11.6, abs=0.02) and rss[0] < 1e-3
    d = K.damped(t, np.exp(-0.03 * t) * np.cos(2 * np.pi * t / 12.2), [12.0])
    assert d["gamma"][0] == pytest.approx(0.03, abs=1e-3) and d["periods"][0] == pytest.approx(12.2, abs=0.01)


def test_pencil_and_tapers():
    t = np.arange(0, 48.0)
    r = K.pencil(t, np.cos(2 * np.pi * t / 12))
    assert r["periods"][0] == pytest.approx(12, abs=1e-3)
    h = K.tapers(48, 2.5, 4)
    assert np.allclose(h @ h.T, np.eye(4), atol=1e-9)
