"""Kernels of single series against plain definitions: every pair, every candidate, dense grids, direct transforms."""

import cmath
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostinato.functions import kernels as K
from ostinato.operators import classify, detect, evidence, fits, network, ranks

T = np.arange(48.0)
wave = lambda period, phase=0.0, t=T: np.cos(2 * np.pi * t / period - phase)


def noisy(seed, *parts, sd=0.3, t=T):
    return sum(parts, np.zeros(len(t))) + np.random.RandomState(seed).normal(0, sd, len(t))


def columns(t, periods):
    return np.array([[1.0] + [f(2 * math.pi * x / p) for p in periods for f in (math.cos, math.sin)] for x in t])


def rss(x, y):
    return float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum())


def arrays(spark, ys, t=T):
    return spark.createDataFrame([(str(i), [float(v) for v in t], [float(v) for v in y]) for i, y in enumerate(ys)], "series_id string, t array<double>, y array<double>")


def f_tail(f, d1, d2, n=200_000):
    """P(F > f) by the trapezoid rule over the beta density, in x = d2 / (d2 + d1 f)."""
    x = np.linspace(0, d2 / (d2 + d1 * f), n + 1)[1:]
    a, b = d2 / 2, d1 / 2
    dens = np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-np.minimum(x, 1 - 1e-15)) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    return float(np.trapezoid(dens, x))


def test_partial_f():
    y = noisy(1, wave(24), 0.2 * wave(12))
    full, reduced = rss(columns(T, [24, 12, 8]), y), rss(columns(T, [24, 8]), y)
    f = ((reduced - full) / 2) / (full / 41)
    assert K.component_p(T, y, [24.0, 12.0, 8.0], 1) == pytest.approx(f_tail(f, 2, 41), rel=1e-3)
    for df in (7, 8, 41):
        assert K.f1_p(2.3, df) == pytest.approx(f_tail(2.3, 1, df), rel=2e-2)


def test_permutation_f_by_hand():
    y = noisy(2, wave(24), 0.25 * wave(12))
    p = [24.0, 12.0, 8.0]
    x, x0 = columns(T, p), columns(T, [24, 8])
    b = np.linalg.lstsq(x0, y, rcond=None)[0]
    rng = np.random.RandomState(5)
    seen, hits = rss(x0, y) / rss(x, y), 0
    for _ in range(99):
        z = x0 @ b + (y - x0 @ b)[rng.permutation(48)]
        hits += rss(x0, z) / rss(x, z) >= seen
    assert K.permutation_p(T, y, p, 1, 99, 5) == pytest.approx((hits + 1) / 100)


def test_free_periods_find_the_best_of_a_dense_grid():
    y = noisy(3, 2 * wave(24.6), wave(11.5, 1.0), sd=0.2)
    _, found = K.free_periods(T, y, [24.0, 12.0])
    best = min(rss(columns(T, [a, b]), y) for a in np.arange(20, 28.01, 0.1) for b in np.arange(10, 14.01, 0.05))
    assert found[0] <= best * 1.002


def test_bootstrap_ratio_by_hand():
    y = noisy(4, 2 * wave(24), wave(11.2, 2.0), sd=0.3)
    lrt, p = K.bootstrap_lrt(T, y, 24.0, 3, [24.0, 12.0, 8.0], 19, 7)
    x = columns(T, [24, 12, 8])
    fitted = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    ratio = lambda z: 48 * math.log(rss(x, z) / K.free_periods(T, z, [24.0, 12.0, 8.0])[1][0])
    sims = fitted + np.random.RandomState(7).normal(0, math.sqrt(((y - fitted) ** 2).mean()), (19, 48))
    assert lrt == pytest.approx(ratio(y), rel=1e-4)
    assert p == pytest.approx((sum(ratio(z) >= lrt for z in sims) + 1) / 20)


def tau_b(a, b):
    s = ta = tb = 0
    n = len(a)
    for i in range(n):
        for j in range(i):
            x, y = np.sign(a[i] - a[j]), np.sign(b[i] - b[j])
            s, ta, tb = s + x * y, ta + (x == 0), tb + (y == 0)
    pairs = n * (n - 1) / 2
    return s / math.sqrt((pairs - ta) * (pairs - tb)) if ta < pairs and tb < pairs else float("nan")


def test_rank_detectors_try_every_candidate():
    y = noisy(5, wave(12, 1.2), sd=0.5)
    periods = np.arange(10.5, 14.5)
    taus = {(p, f): tau_b(y, np.round(np.cos(2 * np.pi / p * T + f), 9)) for p in periods for f in 2 * np.pi * np.arange(8) / 8}
    r = K.jtk(T, y, periods, 8)
    assert abs(r["tau"]) == pytest.approx(max(abs(v) for v in taus.values())) and r["n_tests"] == 32
    assert taus[(r["period"], r["phase"])] == pytest.approx(r["tau"])
    r = K.rain(T, y, 12.0, np.linspace(0.1, 0.9, 9))
    fold = np.round(T % 12 / 12, 12)
    order = np.lexsort((T, fold))
    fold, z = fold[order], y[order]
    best = 1.0
    for f in np.linspace(0.1, 0.9, 9):
        n = int((fold <= f).sum())
        if 2 <= n <= 46:
            ps = []
            for part in (z[:n], z[n:]):
                (tau,), (p,) = K.kendall(part, np.arange(len(part), dtype=float))
                ps.append((p / 2 if tau > 0 else 1 - p / 2, p / 2 if tau < 0 else 1 - p / 2))
            for a, b in ((ps[0][0], ps[1][1]), (ps[0][1], ps[1][0])):
                x = a * b
                best = min(best, x * (1 - math.log(x)))  # Fisher's combination of two
    assert r["p"] == pytest.approx(min(1.0, best * 18), rel=1e-6)


def test_lomb_is_the_explained_share():
    y = noisy(6, wave(12), 0.5 * wave(24))
    for p in (24.0, 12.0, 7.3):
        w = 2 * np.pi / p
        x = np.column_stack([np.cos(w * T), np.sin(w * T)])
        z = y - y.mean()
        assert K.lomb_power(T, y, np.array([p]))[0, 0] == pytest.approx(1 - rss(x, z) / (z @ z))
    r = K.lomb(T, y, [24.0, 12.0, 8.0], 50)
    rng = np.random.default_rng(42)
    null = [max(K.lomb_power(T, z, np.array([24.0, 12.0, 8.0]))[0]) for z in (rng.permutation(y) for _ in range(50))]
    assert r["period"] == 12.0 and r["p"] == (np.mean(np.array(null) >= r["power"]) or 1 / 51)


def test_pencil_recovers_two_damped_waves():
    t = np.arange(0, 72.0)
    y = 3 * np.exp(-0.01 * t) * wave(24, 0.4, t) + 2 * np.exp(-0.02 * t) * wave(12, 1.0, t)
    r = K.pencil(t, y)
    assert any(abs(p - 24) < 1 and abs(g - 0.01) < 0.01 for p, g in zip(r["periods"], r["damping"]))


def test_bicoherence_by_direct_transforms():
    y = noisy(7, wave(24), 0.6 * wave(12))
    n, k = 48, 4
    h = K.tapers(n, 2.5, k)
    ft = lambda z, p: sum(v * cmath.exp(-2j * math.pi * x / p) for v, x in zip(z, T))
    z = y - y.mean()
    pairs = [(ft(z * w, 24.0), ft(z * w, 12.0)) for w in h]
    num = abs(sum(a * a * b.conjugate() for a, b in pairs) / k) ** 2
    den = (sum(abs(a) ** 4 for a, _ in pairs) / k) * (sum(abs(b) ** 2 for _, b in pairs) / k)
    assert K.bicoherence(T, y, 24.0)[0] == pytest.approx(num / den)
    s = K.surrogates(y, 5, np.random.RandomState(0))
    assert np.allclose(np.abs(np.fft.rfft(s - s.mean(axis=1, keepdims=True)))[:, 1:-1], np.abs(np.fft.rfft(z))[1:-1]) and np.allclose(s.mean(axis=1), y.mean())
    r = K.bispectral_test(T, y, 24.0, 49, 3)
    null = [K.bicoherence(T, v, 24.0)[0] for v in K.surrogates(y, 49, np.random.RandomState(3))]
    assert r["p"] == pytest.approx((sum(v >= r["bicoherence"] for v in null) + 1) / 50)


def test_modes_part_two_waves():
    t = np.arange(0, 96.0)
    y = 2 * wave(24, 0.3, t) + wave(12, 1.0, t)
    m = K.vmd(t, y, [24.0, 12.0])
    assert m["periods"] == pytest.approx([24, 12], rel=0.02)
    inner = slice(12, 84)
    assert np.corrcoef(m["modes"][0][inner], wave(24, 0.3, t)[inner])[0, 1] > 0.99 and np.corrcoef(m["modes"][1][inner], wave(12, 1.0, t)[inner])[0, 1] > 0.98
    assert m["energy"][1] / m["energy"][0] == pytest.approx(0.25, rel=0.3)  # narrow filters keep some share of each
    s = K.vmd_summary(t, y, 24.0)
    three = K.vmd(t, y, [24.0, 12.0, 8.0])
    i, j = (int(np.argmin(abs(three["periods"] - p))) for p in (24, 12))
    assert i != j and s["energy_ratio"] == pytest.approx(three["energy"][j] / three["energy"][i]) and s["deviation"] == pytest.approx(abs(three["periods"][j] - 12) / 12)


def test_modes_are_the_least_of_their_definition():
    """Modes minimise the sum of weighted powers for their centres, and centres are the means of their modes' power."""
    rng = np.random.RandomState(4)
    t = np.arange(0, 60.0)
    y = np.stack([2 * wave(24, 0.3, t) + wave(12, i, t) + 0.3 * rng.normal(size=60) for i in range(5)])
    m = K.variational_modes(t, y, [24.0, 12.0])
    f = np.arange(61) / 120
    for i in range(5):
        whole = np.fft.rfft(np.concatenate([y[i, :30][::-1], y[i], y[i, 30:][::-1]]))
        c = 1 / m["periods"][i]

        def cost(u, whole=whole, c=c):
            return sum(2000 * (f - k) ** 2 * abs(x) ** 2 for k, x in zip(c, u)).sum() + (abs(whole - sum(u)) ** 2).sum()

        ease = [1 / (2000 * (f - k) ** 2) for k in c]
        u = [whole * e / (1 + sum(ease)) for e in ease]
        for x, want in zip(m["modes"][i], u):
            assert x == pytest.approx(np.fft.irfft(want, 120)[30:90], abs=1e-9)
        least = cost(u)
        for _ in range(20):
            assert cost([x + 1e-3 * abs(whole) * (rng.normal(size=61) + 1j * rng.normal(size=61)) for x in u]) > least
        for k, x in zip(c, u):
            assert (f[1:] * abs(x[1:]) ** 2).sum() / (abs(x[1:]) ** 2).sum() == pytest.approx(k, abs=1e-6)
    alone = K.vmd(t, y[3], [24.0, 12.0])
    assert alone["periods"] == pytest.approx(m["periods"][3]) and alone["steps"] == m["steps"][3]


def test_instantaneous_frequency_of_a_chirp():
    t = np.arange(0, 200.0)
    y = np.cos(2 * np.pi * (t / 20 + 0.0001 * t**2))
    f = K.instantaneous_frequency(t, y)
    assert np.allclose(f[20:180], (1 / 20 + 0.0002 * t)[20:180], rtol=0.05)
    n = len(y)
    freq = np.fft.fftfreq(n)
    analytic = sum(c * (2 if 0 < q < 0.5 else 1 if q in (0, -0.5) else 0) * np.exp(2j * np.pi * q * t) for c, q in zip(np.fft.fft(y) / n, freq))
    assert np.allclose(np.clip(np.gradient(np.unwrap(np.angle(analytic))) / (2 * np.pi), 0, 0.5), f)


def test_coupling_of_tracks(spark):
    rng = np.random.RandomState(0)
    slow = 0.04 + 0.01 * rng.rand(40)
    cases = [(slow, 2 * slow), (slow, 0.08 + 0.01 * rng.rand(40)), (np.full(40, 0.04), np.full(40, 0.08)), (slow[:20], 2 * slow[:20]), (np.zeros(40), slow), (slow, 3.1 * slow[::-1])]
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(cases)], "i int, a array<double>, b array<double>")
    c = evidence.coupling(F.col("a"), F.col("b"))
    got = {r.i: r for r in df.select("i", c.alias("c"), evidence.coupling_score(c).alias("s")).collect()}
    for i, (a, b) in enumerate(cases):
        steady = all(np.std(x) < 0.01 * abs(np.mean(x)) for x in (a, b))
        r = b[a > 1e-12] / a[a > 1e-12]
        want = (0.0 if steady or np.std(a) == 0 else np.corrcoef(a, b)[0, 1], r.mean() if len(r) > 2 else 0.0, r.std() if len(r) > 2 else 999.0)
        assert (got[i].c.corr, got[i].c.ratio, got[i].c.ratio_sd) == pytest.approx(want, abs=1e-6) and got[i].c.short == (len(a) < 30)
    assert [got[i].s for i in (0, 2, 3, 4)] == [-3.0, 2.0, -3.0, 2.0]


def test_divergence_by_hand():
    beta = np.array([1.0, 2, 0, 0.5, 0.5, 0.1, 0.2])
    e = [4.0, 0.5, 0.05]
    ref = [1, 1 / 4, 1 / 9]
    kl = sum(a / sum(e) * math.log(a / sum(e) / (b / sum(ref))) for a, b in zip(e, ref))
    ph = [0.0, math.atan2(0.5, 0.5), math.atan2(0.2, 0.1)]
    div = sum(e[k] / (e[1] + e[2]) * (1 - math.cos(ph[k] - (k + 1) * ph[0])) for k in (1, 2))
    assert [float(v) for v in K.divergence(beta)] == pytest.approx([kl, div], rel=1e-6)
    y = noisy(8, 2 * wave(24), wave(12, 2.5), sd=0.2)
    sid, p = K.divergence_test(T, y, 24.0, 3, 99, 1)
    b = np.linalg.lstsq(columns(T, [24, 12, 8]), y, rcond=None)[0]
    assert sid == pytest.approx(float(sum(K.divergence(b)))) and p < 0.05


def test_amplitude_ratio_by_hand():
    y = noisy(9, 2 * wave(24), wave(12), sd=0.3)
    x = columns(T, [24, 12, 8])
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    ratio = lambda b: math.hypot(b[3], b[4]) / math.hypot(b[1], b[2])
    sd = math.sqrt(((y - x @ b) ** 2).mean())
    null = [ratio(np.linalg.lstsq(x, x @ b + e, rcond=None)[0]) for e in np.random.RandomState(2).normal(0, sd, (99, 48))]
    seen, p = K.amplitude_ratio_test(T, y, 24.0, 3, 99, 2)
    mid = np.median(null)
    assert seen == pytest.approx(ratio(b)) and p == pytest.approx((sum(abs(v - mid) >= abs(seen - mid) for v in null) + 1) / 100)


def test_savage_dickey_by_a_grid():
    y = noisy(10, 2 * wave(24), wave(12, 0.7), sd=0.5)
    grid = np.exp(np.linspace(math.log(12) - 0.3, math.log(12) + 0.3, 4001))
    lp = np.array([-0.5 * 41 * math.log(rss(columns(T, [24, p, 8]), y)) for p in grid]) - 0.5 * (np.log(grid / 12) / 0.1) ** 2 - np.log(grid)
    post = np.exp(lp - lp.max())
    post /= np.trapezoid(post, grid)
    want = math.log(np.interp(12, grid, post)) - math.log(1 / (12 * 0.1 * math.sqrt(2 * math.pi)))
    r = K.savage_dickey(T, y, 24.0, 1500, 300, 1)
    assert r["log_bf"] == pytest.approx(want, abs=0.3) and r["mean"] == pytest.approx(np.trapezoid(grid * post, grid), abs=0.05)


def test_waic_prefers_the_model_that_made_the_series():
    tied = noisy(11, 2 * wave(24), wave(12, 0.5), sd=0.3)
    free = noisy(12, 2 * wave(24), 2 * wave(11, 0.5), sd=0.3)
    assert K.waic_of_periods(T, free, 24.0, 1)["delta_waic"] > 10 > K.waic_of_periods(T, tied, 24.0, 1)["delta_waic"]


def test_goodwin_fits_and_sees_an_own_second_loop():
    alone, both = noisy(13, 2 * wave(24), sd=0.1), noisy(13, 2 * wave(24), 2 * wave(12, 1.3), sd=0.1)
    a, b = K.goodwin(T, alone, 24.0, 1), K.goodwin(T, both, 24.0, 1)
    assert a["r2"] > 0.9 and b["r2"] > 0.8 and b["own"] > 0.0


def test_bootstrap_interval_covers_the_mean():
    x = np.random.RandomState(0).normal(5, 1, 400)
    lo, hi = K.bootstrap_interval(x, 500, 1)
    assert lo < x.mean() < hi and hi - lo == pytest.approx(2 * 1.96 * x.std() / 20, rel=0.15)
    assert all(math.isnan(v) for v in K.bootstrap_interval(np.zeros(0), 10, 1))


def test_gate_b_by_a_search_of_phases():
    """A half period whose phase is tied to twice the base's leaves a free phase little to add."""
    tied, untied = noisy(14, 2 * wave(24, 0.6), wave(12, 1.2), sd=0.2), noisy(14, 2 * wave(24, 0.6), wave(12, 1.2 + math.pi / 2), sd=0.2)
    assert detect.phase_freedom_p(T, tied, 24.0) > 0.05 > 1e-3 > detect.phase_freedom_p(T, untied, 24.0)


def test_model_numbers_by_least_squares():
    y = noisy(15, 2 * wave(24, 0.5), 0.8 * wave(12, 2.0), sd=0.3)
    m = evidence.model_numbers(T, y, 24.0)
    b = np.linalg.lstsq(columns(T, [24, 12, 8]), y, rcond=None)[0]
    assert (m["amp_24"], m["amp_12"], m["phi_12"]) == pytest.approx((math.hypot(b[1], b[2]), math.hypot(b[3], b[4]), math.atan2(b[4], b[3])))
    assert m["rss0"] == pytest.approx(rss(columns(T, [24, 12, 8]), y)) and m["rss_k4"] == pytest.approx(rss(columns(T, [24, 12, 8, 6]), y)) and m["tss"] == pytest.approx(((y - y.mean()) ** 2).sum())
    s2 = m["rss0"] / 48
    ll = -24 * math.log(2 * math.pi * s2) - 24
    assert m["bic0"] == pytest.approx(-2 * ll + 8 * math.log(48)) and m["aicc0"] == pytest.approx(-2 * ll + 16 + 144 / 39)
    assert T[int(np.argmax(y))] % 24 / 24 == pytest.approx(m["peak_phase"])


def test_fits_of_several_models_and_odd_series(spark):
    ys = [noisy(i, wave(24), sd=1) for i in range(4)]
    df = arrays(spark, ys).unionByName(spark.createDataFrame([("n", None, None), ("s", [0.0], [1.0]), ("h", T.tolist(), [None, *ys[0][1:].tolist()])], "series_id string, t array<double>, y array<double>"))
    r = {x.series_id: x for x in fits.with_fits(df, T, {"a": [24.0, 12.0], "b": [24.0], "c": []}).collect()}
    for i, y in enumerate(ys):
        assert (r[str(i)].a.rss, r[str(i)].b.rss, r[str(i)].c.rss) == pytest.approx((rss(columns(T, [24, 12]), y), rss(columns(T, [24]), y), ((y - y.mean()) ** 2).sum()))
        assert r[str(i)].a.tss == pytest.approx(r[str(i)].c.rss) and r[str(i)].a.mesor == pytest.approx(np.linalg.lstsq(columns(T, [24, 12]), y, rcond=None)[0][0])
    assert all(r[k].a.rss is None and r[k].a.beta is None for k in "nsh")


def test_running_sums_and_quantiles(spark):
    rng = np.random.RandomState(1)
    v, g = np.round(rng.normal(size=500), 1), rng.randint(0, 3, 500)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, v)] + [(7, None), (8, float("nan"))], "g int, v double").repartition(5)
    for buckets in (1, 4, 64):
        r = ranks.running(df.where("g < 7").groupBy("g", "v").agg(F.count("*").alias("c")), "v", {"below": F.col("c")}, ["g"], buckets).collect()
        assert all(x.below == ((g == x.g) & (v < x.v)).sum() and x.below_all == (g == x.g).sum() for x in r)
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {x.g: x.percentile for x in ranks.percentile(df, F.col("v"), q, ["g"]).collect()}
        assert got == pytest.approx({k: np.percentile(v[g == k], 100 * q) for k in range(3)})
        assert ranks.percentile(df, F.col("v"), q).first().percentile == pytest.approx(np.percentile(v, 100 * q))
    assert ranks.percentile(df.limit(0), F.col("v"), 0.5).first().percentile is None


def test_classifiers_on_plain_cases(spark):
    """Each tree on a base rhythm, on noise, on a tied harmonic, on an independent half period."""
    t = np.arange(0, 96.0, 2)
    saw = lambda t: 3 * (np.mod(t / 24, 1) - 0.5)
    ys = [noisy(1, 3 * wave(24, 0.3, t), sd=0.3, t=t), noisy(2, sd=1.0, t=t), noisy(3, saw(t), sd=0.2, t=t), noisy(4, 2 * wave(24, 0.5, t), 2 * wave(11.3, 2.1, t), sd=0.3, t=t)]
    df = arrays(spark, ys, t)
    independent = {"independent_ultradian", "likely_independent_ultradian"}
    for version in (1, 2):
        got = {r.series_id: r.classification for r in classify.analytic(df, version=version, n_bootstrap=49, n_perm=49).collect()}
        assert got["3"] in independent and not {got["0"], got["1"], got["2"]} & independent, (version, got)
    f = {r.series_id: r for r in classify.fusion(df).collect()}
    assert f["3"].classification in independent | {"harmonic"} and f["1"].classification not in independent and all(r.reason for r in f.values())
    e = {r.series_id: r for r in classify.ensemble(df, n_bootstrap=49).collect()}
    assert e["3"].classification in independent and all(r.confidence in ("high", "medium", "low") for r in e.values())
    a = {r.series_id: r for r in classify.two_stage(df, classify.Config.for_tissue("Ovary", 48)).collect()}
    assert a["3"].classification in independent and a["1"].classification == "non_rhythmic"


def test_tissue_presets():
    c = classify.Config.for_tissue
    assert c() == classify.Config() == c("liver") and c("liver", 48).alpha == 0.05 and c("liver", 30).alpha == 0.10 and c("liver", 10).alpha == 0.20
    assert (c("OVARY ").independent, c("ovary").likely, c("ovary").vmd_gate) == (0.5, 0.25, 0.12) and c("uterus", 20).alpha == 0.5 and c("uterus", 40).alpha == 0.10
    assert (c("heart").likely, c("muscle").harmonic, c("heart").likely_harmonic) == (0.35, -0.55, -0.25)
    assert (c("fibroblast").likely, c("cell_line").harmonic, c("in_vitro").vmd_gate) == (0.2, -0.5, 0.10) and c("kidney").bispectral_nonsin == 0.3


def test_modules_by_bisecting(spark):
    kinds = np.array([[5.0, 0, 0, 1], [0, 5, 1, 0], [0, 0, 5, 5]])
    x = np.vstack([c + np.random.RandomState(i).normal(0, 0.1, (10, 4)) for i, c in enumerate(kinds)])
    df = spark.createDataFrame([(str(i), *map(float, v)) for i, v in enumerate(x)], "series_id string, a double, b double, c double, d double")
    for method, k in (("ward", None), ("ward", 3), ("spectral", 3), ("bisecting", 3)):
        m = {r.series_id: r.module_id for r in network.modules(df, k, method, least=2).collect()}
        parts = [{m[str(i)] for i in range(j, j + 10)} for j in (0, 10, 20)]
        assert len(m) == 30 and [len(p) for p in parts] == [1, 1, 1] and len(set.union(*parts)) == 3, method
    few = {r.series_id: r.module_id for r in network.modules(df, 3, "ward", least=2, most_leaves=9).collect()}
    assert [len({few[str(i)] for i in range(j, j + 10)}) for j in (0, 10, 20)] == [1, 1, 1] and len(set(few.values())) == 3


def test_refinement_of_ambiguous_series(spark):
    rows = [(str(i), 0, 1.0 + 0.01 * i, 0.5, 0.3, 0.2, "independent_ultradian" if i < 5 else "ambiguous", True, 0.01, 2.0) for i in range(6)] + [(str(10 + i), 1, 0.1, 2.0 + 0.01 * i, 2.0, 1.0, "harmonic" if i < 5 else "ambiguous", False, 0.0, -2.0) for i in range(6)]
    df = spark.createDataFrame(rows, "series_id string, module_id int, A_12 double, A_24 double, phi_12 double, phi_24 double, classification string, f_test_12h_significant boolean, T_12_deviation double, log_bf double")
    e = network.enrichment(df)
    got = {r.series_id: r.refined for r in network.refine(df, e, alpha=0.5).collect()}
    assert got["5"] in ("likely_independent_ultradian", "ambiguous") and got["0"] == "independent_ultradian" and len(got) == 12
    h = {r.series_id: r.hierarchical_classification for r in network.hierarchical(df.drop("module_id"), 2, least=3, method="bisecting").collect()}
    assert h["5"] == "likely_independent" and h["15"] == "likely_harmonic"


def test_lattice_finds_what_the_search_finds():
    """On 50 vectors of the test tables: the same periods, residual sums and p of the bootstrap."""
    import pyarrow.parquet as pq

    t, three = np.arange(64.0), [24.0, 12.0, 8.0]
    y = np.array(pq.read_table("/root/testdata/sf0.001/embeddings.parquet").column("embedding").to_pylist()[:50], float)
    found, rss_found = K.nearest_periods(t, y, three)
    want, rss_want = K.free_periods(t, y, three)
    assert np.abs(found - want).max() < 1e-2 and rss_found == pytest.approx(rss_want, rel=1e-6)
    x = columns(t, three)
    proj = x @ np.linalg.pinv(x)
    for i, z in enumerate(y):
        lrt, p = K.bootstrap_lrt(t, z, 24.0, 3, three, 9, i)
        fitted = proj @ z
        sims = np.vstack([z, fitted + np.random.RandomState(i).normal(0, math.sqrt(((z - fitted) ** 2).mean()), (9, 64))])
        ratio = 64 * np.log(((sims - sims @ proj.T) ** 2).sum(axis=1) / K.free_periods(t, sims, three)[1])
        assert lrt == pytest.approx(ratio[0], rel=1e-5, abs=1e-6) and p == pytest.approx(((ratio[1:] >= ratio[0]).sum() + 1) / 10)


@pytest.mark.parametrize("t", [np.arange(12.0) * 4, np.sort(np.random.RandomState(2).uniform(0, 72, 30)), np.arange(200.0) / 2])
def test_lattice_on_other_times(t):
    """Few points, irregular and long series: no worse than the search, whose cells it shares."""
    rng = np.random.RandomState(3)
    y = np.stack([np.cos(2 * np.pi * t / 23.3 + i) + 0.6 * np.cos(2 * np.pi * t / 12.4) + 0.3 * rng.normal(size=len(t)) for i in range(8)])
    found, got = K.nearest_periods(t, y, [24.0, 12.0])
    _, want = K.free_periods(t, y, [24.0, 12.0])
    assert (got <= want * (1 + 1e-6) + 1e-9).all()
    for p, z, r in zip(found, y, got, strict=True):
        assert rss(columns(t, p), z) == pytest.approx(r, rel=1e-6, abs=1e-9)


def test_blocks_of_simulations_add_up(spark):
    from ostinato.operators import evidence

    rows = [(str(i), [float(x) for x in T], [float(v) for v in noisy(i, 2 * wave(24), wave(11.6, 0.7), sd=0.4)]) for i in range(3)] + [("2", None, None)]
    df = spark.createDataFrame(rows, "series_id string, t array<double>, y array<double>")
    plain = lambda d: sorted(((r.series_id, r.lrt, r.p_lrt, r.lrt_label, r.error) for r in d.collect()), key=str)
    assert plain(evidence.bootstrap_lrt(df, n=99)) == plain(evidence.bootstrap_lrt(df, n=99, blocks=4))


def test_samplers_as_operators(spark):
    from ostinato.operators import evidence

    rows = [(str(i), [float(x) for x in T], [float(v) for v in noisy(i + 20, 2 * wave(24), wave(p, 1.2), sd=0.4)]) for i, p in enumerate((12.0, 13.2))] + [("short", [0.0, 1.0], [1.0, 2.0]), ("none", None, None)]
    df = spark.createDataFrame(rows, "series_id string, t array<double>, y array<double>")
    m = {r.series_id: r for r in evidence.model_comparison(df).collect()}
    assert m["0"].delta_waic < 2 < 6 < m["1"].delta_waic and m["1"].posterior_label == "independent_ultradian" and m["0"].rhat < 1.2
    assert m["short"].error == "fewer than 12 points" and m["none"].error == "no series" and m["none"].posterior_label is None
    s = {r.series_id: r for r in evidence.savage_dickey(df).collect()}
    assert s["0"].sd_log_bf > 0 > s["1"].sd_log_bf and s["0"].sd_score == -1 - (s["0"].sd_log_bf > 3) + (s["0"].sd_log_bf <= 1) and s["short"].error
    assert evidence.savage_dickey(df, method="period").where("sd_log_bf is not null").count() == 2
    assert evidence.model_comparison(df, method="importance").where("waic_label is not null").count() >= 2
    assert evidence.model_comparison(df.limit(0)).count() == 0


def test_adjusted_p_values_meet_rows_whose_values_differ_in_every_run(spark):
    """As sums of floats do in their last digits: rows and values to adjust must come from one evaluation."""
    import random

    draw = F.udf(lambda i: random.random() if i % 7 else None, "double").asNondeterministic()
    df = spark.range(200).withColumn("x", F.col("id") * 2).withColumn("p", draw("id"))
    got = detect.bh_fdr(df, "p", "q").select("id", "p", "q").toPandas()
    assert got.q.isna().equals(got.p.isna()) and got.p.notna().sum() == 171
    p = got.dropna().sort_values("p")
    want = (p.p * len(p) / np.arange(1, len(p) + 1))[::-1].cummin()[::-1]
    assert np.allclose(p.q, np.minimum(want, 1))
    assert detect.bh_fdr(df, "p", "q").select("id", "q").where("q is null").count() == 29


def test_rank_tests_find_p_of_the_largest_alone(monkeypatch):
    """Cost of a series: one p, not one for each candidate; the order of pairs once, not for each fraction."""
    y = noisy(4, 0.4 * wave(12, t=np.arange(64.0)), t=np.arange(64.0))
    calls = []
    normal = K.kendall
    monkeypatch.setattr(K, "kendall", lambda a, b: (calls.append(len(np.atleast_2d(b))), normal(a, b))[1])
    r = K.jtk(np.arange(64.0), y, np.arange(10, 14.25, 0.5), 24)
    u = K.rain(np.arange(64.0), y, 12.0, np.linspace(0.1, 0.9, 17))
    assert r["n_tests"] == 216 and calls == [1] and 0 < r["p"] <= 1 and 0 < u["p"] <= 1


@pytest.mark.parametrize("ties", [False, True])
def test_umbrella_of_many_points_by_all_splits(ties):
    rng = np.random.RandomState(11)
    y = rng.normal(size=70)
    y, t = (np.round(y) if ties else y), np.arange(70.0)
    phase = np.round(np.mod(t, 12) / 12, 12)
    z, f = y[np.lexsort((t, phase))], np.sort(phase)
    best = 1.0
    for share in np.linspace(0.1, 0.9, 9):
        n = int((f <= share).sum())
        sides = [[float(v[0]) for v in K.kendall(part, np.arange(len(part), dtype=float))] for part in (z[:n], z[n:])]
        for sign in (1, -1):
            tails = [p / 2 if s * tau > 0 else 1 - p / 2 for (tau, p), s in zip(sides, (sign, -sign))]
            chi = -2 * sum(math.log(max(q, 1e-20)) for q in tails)
            best = min(best, math.exp(-chi / 2) * (1 + chi / 2))
    assert K.rain(t, y, 12.0, np.linspace(0.1, 0.9, 9))["p"] == pytest.approx(min(1, best * 18), rel=1e-10)


def test_shared_periods_are_solved_once(monkeypatch):
    """Partial F, tied phases and permutations of further series of the same times make no new decomposition."""
    y, z = noisy(5, wave(24)), noisy(6, wave(12))
    first = detect.stage1_numbers(T, y, 24.0), K.permutation_p(T, y, [24.0, 12.0, 8.0], 1, 9, 1)
    for name in ("lstsq", "pinv", "svd", "qr"):
        monkeypatch.setattr(np.linalg, name, None)
    assert (detect.stage1_numbers(T, y, 24.0), K.permutation_p(T, y, [24.0, 12.0, 8.0], 1, 9, 1)) == first
    assert detect.stage1_numbers(T, z, 24.0)["p_ftest"] < 1e-6


def test_goodwin_loops_of_a_block(monkeypatch):
    """A series has the same loops alone and in a block, and a block takes no more steps of the integration than a series does."""
    ys = np.array([noisy(i, wave(24), 0.3 * wave(12)) for i in range(5)])
    alone = [K.goodwin(T, y, 24.0, i, generations=2) for i, y in enumerate(ys)]
    steps, clip = [], np.clip
    monkeypatch.setattr(np, "clip", lambda *a, **k: (steps.append(1), clip(*a, **k))[1])
    one = (K.goodwin(T, ys[0], 24.0, 0, generations=2), len(steps))[1]
    assert K.goodwins(T, ys, 24.0, list(range(5)), generations=2) == alone and len(steps) == 2 * one


def test_damped_sums_of_a_block_take_one_decomposition_a_round(monkeypatch):
    """The slopes are those of differences: at the end no small step of a period or damping leaves less."""
    ys = np.array([noisy(i, np.exp(-0.01 * T) * wave(23.4, i), 0.5 * wave(12.3)) for i in range(5)])
    alone = [K.damped(T, y, [24.0, 12.0, 8.0]) for y in ys]
    calls, svd = [], np.linalg.svd
    monkeypatch.setattr(np.linalg, "svd", lambda *a, **k: (calls.append(1), svd(*a, **k))[1])
    block = K.damped_sums(T, ys, [24.0, 12.0, 8.0])
    assert len(calls) <= 31
    for y, a, b in zip(ys, alone, block, strict=True):
        assert all(np.array_equal(a[k], b[k]) for k in a) and abs(b["periods"][0] - 23.4) < 0.5

        def left(p, g, y=y):
            w, fall = 2 * np.pi * T[:, None] / p, np.exp(-T[:, None] * g)
            return rss(np.hstack([np.ones((48, 1)), fall * np.cos(w), fall * np.sin(w)]), y)

        least = left(b["periods"], b["gamma"])
        assert 1 - least / ((y - y.mean()) ** 2).sum() == pytest.approx(b["r2"], abs=1e-9)
        for i in range(3):
            for step in (-1e-2, 1e-2):
                assert left(b["periods"] + step * (np.arange(3) == i), b["gamma"]) > least - 1e-3


def test_damping_summary_reads_its_rows_once(spark):
    """What makes the rows runs once: of one row a group with a new damping in each run, mean and median are the same."""
    import random

    from ostinato.operators import population

    draw = F.udf(lambda i: random.random(), "double").asNondeterministic()
    rows = spark.range(20).select("id", draw("id").alias("gamma"), (F.lit(10.0) + draw("id")).alias("period"), F.lit("x").alias("other"))
    got = population.damping_summary(rows, ["id"]).toPandas()
    assert len(got) == 20 and np.allclose(got.mean_gamma, got.median_gamma)


def test_lattice_work_of_a_bootstrap(monkeypatch):
    """The search meets the coarse periods alone, in single precision where times span two turns, and finds what all digits find."""
    t = np.arange(64.0)
    lat = K.Lattice(t, (24.0, 12.0, 8.0), 0.17)
    assert all(p["search"].shape[1] == 2 * len(p["coarse"]) < 2 * len(p["periods"]) and p["search"].dtype == np.float32 for p in lat.parts)
    ys = np.array([noisy(i, wave(23.1, t=t), 10.0 ** -(i % 5) * wave(12.4, i, t), sd=10.0 ** -(i % 3 + 1), t=t) for i in range(20)])
    at, left = K.nearest_periods(t, ys, [24.0, 12.0, 8.0])
    monkeypatch.setattr(K, "_lattice", lambda *a: exact)
    exact = K.Lattice(t, (24.0, 12.0, 8.0), 0.17)
    exact.kind, exact.least = np.float64, 1e-10
    for p in exact.parts:
        b = p["b"][:, p["coarse"]]
        p["search"] = b.reshape(-1, b.shape[-1]).T
    at2, left2 = K.nearest_periods(t, ys, [24.0, 12.0, 8.0])
    assert np.allclose(at, at2, atol=1e-6) and np.allclose(left, left2, rtol=1e-6)
    one = [K.nearest_periods(t, y, [24.0, 12.0, 8.0]) for y in ys]
    assert np.allclose(np.concatenate([p for p, _ in one]), at2, atol=1e-6)


def test_fits_of_a_block_find_free_periods_together(monkeypatch):
    calls = []
    found = K.nearest_periods
    monkeypatch.setattr(K, "nearest_periods", lambda t, y, *a: (calls.append(len(y)), found(t, y, *a))[1])
    ys = np.array([noisy(i, wave(24), 0.3 * wave(12)) for i in range(4)])
    free = evidence._free(T, ys, 24.0)
    assert calls == [4]
    for i, y in enumerate(ys):
        a, b = evidence.model_numbers(T, y, 24.0), evidence.model_numbers(T, y, 24.0, found=(free[0][i], free[1][i]))
        assert all(np.allclose(a[k], b[k]) for k in a)


@pytest.mark.parametrize("n, step", [(64, 1.0), (33, 2.0), (17, 1.5)])
def test_halves_of_a_regular_grid(n, step):
    """Even and odd halves about a grid's middle: the periods of the general way, which a grid bent by a hair takes, in well under its time."""
    rng = np.random.RandomState(3)
    t = step * np.arange(n)
    bent = t + np.where(np.arange(n) == 1, 1e-11, 0)
    y = rng.normal(size=(1000, n))
    y[:300] += rng.uniform(0, 3, (300, 1)) * np.cos(2 * np.pi * t / 23) + rng.uniform(0, 3, (300, 1)) * np.sin(2 * np.pi * t / 11.7)
    at, rss = K.nearest_periods(t, y, [24.0, 12.0, 8.0])
    want, want_rss = K.nearest_periods(bent, y, [24.0, 12.0, 8.0])
    assert K._lattice(t.tobytes(), (24.0, 12.0, 8.0), 0.17).regular and not K._lattice(bent.tobytes(), (24.0, 12.0, 8.0), 0.17).regular
    assert np.abs(at - want).max() < 1e-5 and np.allclose(rss, want_rss, rtol=1e-7)
    took = {}
    for _ in range(5):
        for name, grid in (("even", t), ("bent", bent)):
            begin = time.perf_counter()
            K.nearest_periods(grid, y, [24.0, 12.0, 8.0])
            took[name] = min(took.get(name, 9.0), time.perf_counter() - begin)
    assert took["even"] < 0.8 * took["bent"], took


def test_ensemble_simulates_each_series_once(spark):
    """One pass of simulations for both answers, which are those of two passes."""
    t = np.arange(0, 96.0, 2)
    ys = [noisy(1, 3 * wave(24, 0.3, t), t=t), noisy(2, sd=1.0, t=t), noisy(4, 2 * wave(24, 0.5, t), 2 * wave(11.3, 2.1, t), t=t), noisy(5, wave(24, 0.5, t), 0.3 * wave(12, 1, t), sd=0.5, t=t)]
    df = arrays(spark, ys, t)
    passes = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    once, one = classify.ensemble(df, n_bootstrap=19), classify.analytic(df, n_bootstrap=19)
    assert passes(once) == passes(one)
    two = {r.series_id: r for r in evidence.bootstrap_lrt(one, n=19).collect()}
    plain = {r.series_id: r.classification for r in one.collect()}
    for r in once.collect():
        assert (r.p_lrt, r.lrt_label, r.analytic_label) == (two[r.series_id].p_lrt, two[r.series_id].lrt_label, plain[r.series_id])
