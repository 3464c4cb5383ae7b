"""Queries of population statistics, metrics, the ensemble's vote, modules and the relational steps."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import ensemble, metrics, network, population, relational
from . import inputs as I

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TWO_PI = "(2 * pi())"
_RAY = "least(1.0, greatest(0.0, CASE WHEN n >= 10 THEN exp(-z) * (1 + (2*z - z*z)/(4*n) - (24*z - 132*z*z + 76*z*z*z - 9*z*z*z*z)/(288.0*n*n)) ELSE exp(-z) END))"


def _rayleigh_sql(source: str, key: str, angle: str) -> str:
    return f"WITH g AS (SELECT {key}, count({angle}) AS n, avg(cos({angle})) AS c, avg(sin({angle})) AS s FROM {source} GROUP BY {key}), h AS (SELECT *, n * (c*c + s*s) AS z FROM g)"


@query(_rayleigh_sql("events", "event_type", "value") + " SELECT event_type, n, " + ", ".join([I.q6("sqrt(c*c + s*s)", "r"), I.q6("z", "z"), I.q6(_RAY, "p_value"), I.q6(f"atan2(s, c) - {_TWO_PI} * floor(atan2(s, c) / {_TWO_PI})", "mean_direction")]) + " FROM h")
def rayleigh(spark, d):
    r = population.rayleigh(I.table(spark, d, "events"), F.col("value"), ["event_type"])
    return r.select("event_type", "n", *[I.r6(F.col(c), c) for c in ("r", "z", "p_value", "mean_direction")])


_SCORE = "CAST(CASE WHEN n < 5 THEN 0 WHEN p < 0.001 THEN -3 WHEN p < 0.01 THEN -2 WHEN p < 0.05 THEN -1 WHEN p > 0.5 THEN 2 WHEN p > 0.2 THEN 1 ELSE 0 END AS DOUBLE)"
_PHASES = I.fit_sql((24, 12)) + ", ph AS (SELECT label, phi12 - 2 * phi24 AS psi FROM f), g AS (SELECT label, count(*) AS n, avg(cos(psi)) AS c, avg(sin(psi)) AS s FROM ph GROUP BY label), h AS (SELECT *, n * (c*c + s*s) AS z FROM g), w AS (SELECT *, " + _RAY + " AS p FROM h)"


def _phased(spark, d):
    from ..operators import fits

    v = I.vectors_with_label(spark, d)
    return fits.phases(v, I.GRID, [24.0, 12.0])


@query(_PHASES + f" SELECT label, n, {I.q6('p', 'p_value')}, CASE WHEN n < 5 THEN 'inconclusive' WHEN p < 0.05 THEN 'harmonic' WHEN p > 0.2 THEN 'independent' ELSE 'inconclusive' END AS classification, {_SCORE} AS evidence_score FROM w")
def cross_series_phase(spark, d):
    r = population.phase_test(_phased(spark, d), keys=["label"])
    return r.select("label", "n", I.r6(F.col("p_value"), "p_value"), "classification", "evidence_score")


@query(I.fit_sql((24, 12)) + f" SELECT count(*) AS n, {I.q6('(SELECT sum(sin(x.phi24 - y.phi24) * sin(x.phi12 - y.phi12)) / sqrt(sum(pow(sin(x.phi24 - y.phi24), 2)) * sum(pow(sin(x.phi12 - y.phi12), 2))) FROM f x, f y)', 'rho')} FROM f")
def circular_correlation(spark, d):
    r = population.circular_correlation(_phased(spark, d), F.col("phase_24"), F.col("phase_12"))
    return r.select("n", I.r6(F.col("rho"), "rho"))


@query()
def circular_permutation(spark, d):
    return population.circular_permutation(_phased(spark, d), "phase_24", "phase_12")


@query()
def population_phases(spark, d):
    return population.population_phases(_phased(spark, d))


_TAB = "SELECT p_brand, count_if(p_size > 25 AND p_retailprice > 1400) AS b, count_if(p_size > 25 AND NOT p_retailprice > 1400) AS o12, count_if(NOT p_size > 25 AND p_retailprice > 1400) AS o24, count_if(NOT p_size > 25 AND NOT p_retailprice > 1400) AS nn FROM part GROUP BY p_brand"


@query(f"SELECT p_brand, b AS n_both, o12 AS n_12h_only, o24 AS n_24h_only, nn AS n_neither, {I.q6('CASE WHEN (b + o12) * (b + o24) > 0 THEN b / ((b + o12) * (b + o24) / (b + o12 + o24 + nn)) ELSE 1 END', 'observed_expected_ratio')}, {I.q6('CASE WHEN (b + o12) * (b + o24) * (o24 + nn) * (o12 + nn) > 0 THEN (b + o12 + o24 + nn) * pow(b * nn - o12 * o24, 2) / ((b + o12) * (b + o24) * (o24 + nn) * (o12 + nn)) ELSE 0 END', 'chi2')} FROM ({_TAB})")
def independence_test(spark, d):
    r = population.independence(I.table(spark, d, "part"), F.col("p_retailprice") > 1400, F.col("p_size") > 25, ["p_brand"])
    return r.select("p_brand", "n_both", "n_12h_only", "n_24h_only", "n_neither", I.r6(F.col("observed_expected_ratio"), "observed_expected_ratio"), I.r6(F.col("chi2"), "chi2"))


_LF = "lgamma({0} + 1.0)"


def _pmf(j: str) -> str:
    lf = lambda x: f"lgamma(({x}) + 1.0)"
    return f"exp({lf('mk')} - {lf(j)} - {lf(f'mk - {j}')} + {lf('tt - mk')} - {lf(f'dr - {j}')} - {lf(f'tt - mk - dr + {j}')} - {lf('tt')} + {lf('dr')} + {lf('tt - dr')})"


@query(f"WITH t AS (SELECT p_brand, b, b + o12 AS dr, b + o24 AS mk, b + o12 + o24 + nn AS tt FROM ({_TAB})), j AS (SELECT t.*, unnest(generate_series(greatest(0, dr + mk - tt), least(mk, dr))) AS j FROM t), pj AS (SELECT *, {_pmf('j')} AS pj, {_pmf('b')} * (1 + 1e-7) AS seen FROM j) SELECT p_brand, {I.q6('least(1.0, sum(CASE WHEN j >= b THEN pj ELSE 0 END))', 'p_one_sided')}, {I.q6('least(1.0, sum(CASE WHEN pj <= seen THEN pj ELSE 0 END))', 'p_two_sided')} FROM pj GROUP BY p_brand")
def fisher_exact(spark, d):
    r = population.independence(I.table(spark, d, "part"), F.col("p_retailprice") > 1400, F.col("p_size") > 25, ["p_brand"])
    a, b, c, e = (F.col(x) for x in ("n_both", "n_12h_only", "n_24h_only", "n_neither"))
    return r.select("p_brand", I.r6(S.hypergeometric_sf(a, a + b + c + e, a + c, a + b), "p_one_sided"), I.r6(S.fisher_two_sided(a, b, c, e), "p_two_sided"))


_RANKS = "SELECT l_returnflag, l_extendedprice AS v, l_linestatus = 'O' AS g FROM lineitem"


@query(f"WITH r AS ({_RANKS}), k AS (SELECT *, (rank() OVER (PARTITION BY l_returnflag ORDER BY v) + rank() OVER (PARTITION BY l_returnflag ORDER BY v) + count(*) OVER (PARTITION BY l_returnflag, v) - 1) / 2.0 AS rk FROM r), a AS (SELECT l_returnflag, count_if(NOT g) AS n1, count_if(g) AS n2, sum(CASE WHEN NOT g THEN rk ELSE 0 END) AS r1, quantile_cont(CASE WHEN NOT g THEN v END, 0.5) AS m1, quantile_cont(CASE WHEN g THEN v END, 0.5) AS m2 FROM k GROUP BY l_returnflag) SELECT l_returnflag, n1, n2, {I.q6('m1', 'median_1')}, {I.q6('m2', 'median_2')}, {I.q6('CAST(r1 - n1 * (n1 + 1) / 2 AS DOUBLE)', 'u')}, {I.q6('1 - 2 * CAST(r1 - n1 * (n1 + 1) / 2 AS DOUBLE) / (CAST(n1 AS DOUBLE) * n2)', 'rank_biserial')}, {I.q6('log2(m2 / m1)', 'log2fc')} FROM a")
def mann_whitney(spark, d):
    r = population.mann_whitney(I.table(spark, d, "lineitem"), F.col("l_extendedprice"), F.col("l_linestatus") == "O", ["l_returnflag"])
    return r.select("l_returnflag", "n1", "n2", *[I.r6(F.col(c), c) for c in ("median_1", "median_2", "u", "rank_biserial", "log2fc")])


@query(f"WITH r AS (SELECT l_returnflag, (2 * rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS a, (2 * rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT l_returnflag, count(*) AS n, {I.q6('corr(a, b)', 'spearman')} FROM r GROUP BY l_returnflag")
def spearman(spark, d):
    r = population.spearman(I.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return r.select("l_returnflag", "n", I.r6(F.col("spearman"), "spearman"))


_GAMMA = "SELECT l_returnflag AS g, l_discount AS gamma, l_quantity AS period FROM lineitem"


@query(f"SELECT g, {I.q6('quantile_cont(period, 0.5)', 'median_period')}, {I.q6('quantile_cont(gamma, 0.5)', 'median_gamma')}, {I.q6('avg(gamma)', 'mean_gamma')}, {I.q6('stddev_pop(gamma)', 'sd_gamma')}, {I.q6('quantile_cont(CASE WHEN gamma > 0 THEN ln(2) / gamma END, 0.5)', 'median_half_life')}, {I.q6('avg(CASE WHEN 2 * pi() / period / (2 * gamma + 1e-10) > 0.5 THEN 1.0 ELSE 0.0 END)', 'share_underdamped')} FROM ({_GAMMA}) GROUP BY g")
def damping_summary(spark, d):
    li = I.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_discount").alias("gamma"), F.col("l_quantity").alias("period"))
    r = population.damping_summary(li, ["g"])
    return r.select("g", *[I.r6(F.col(c), c) for c in ("median_period", "median_gamma", "mean_gamma", "sd_gamma", "median_half_life", "share_underdamped")])


@query("SELECT CAST(a.s_suppkey AS VARCHAR) AS series_id, CASE WHEN a.s_acctbal > 0 AND b.n % 10 < 5 AND NOT (b.n > 600) THEN 'dying' WHEN NOT (a.s_acctbal > 0 AND b.n % 10 < 5) AND b.n > 600 THEN 'gained' ELSE 'stable' END AS fate FROM supplier a JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) b ON a.s_suppkey = b.l_suppkey")
def oscillator_fate(spark, d):
    n = I.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    j = I.table(spark, d, "supplier").join(n, F.col("s_suppkey") == F.col("l_suppkey"))
    a = j.select(F.col("s_suppkey").cast("string").alias("series_id"), (F.col("n") % 10 / 100).alias("gamma"), (F.col("s_acctbal") > 0).alias("active"))
    b = j.select(F.col("s_suppkey").cast("string").alias("series_id"), F.lit(0.0).alias("gamma"), (F.col("n") > 600).alias("active"))
    return population.oscillator_fate(a, b).select("series_id", "fate")


# --- modules -----------------------------------------------------------------------------------------------------

_MOD = I.fit_sql((24, 12, 8, 6)) + ", md AS (SELECT CAST(label AS INTEGER) AS module_id, series_id, amp12 AS A_12, amp24 AS A_24, phi12 AS phi_12, phi24 AS phi_24, CASE WHEN amp12 > 1.2 * amp24 THEN 'independent_ultradian' WHEN amp12 > amp24 THEN 'ambiguous' ELSE 'harmonic' END AS classification, amp12 > 0.1 AS f_test_12h_significant, amp8 - amp6 AS T_12_deviation FROM f)"


def _moduled(spark, d):
    from ..operators import fits

    v = fits.phases(I.vectors_with_label(spark, d), I.GRID, [24.0, 12.0, 8.0, 6.0])
    a12, a24 = F.col("amp_12"), F.col("amp_24")
    label = F.when(a12 > 1.2 * a24, "independent_ultradian").when(a12 > a24, "ambiguous").otherwise("harmonic")
    signed = lambda c: F.when(F.col(c) > math.pi, F.col(c) - 2 * math.pi).otherwise(F.col(c))
    return v.select(F.col("label").cast("int").alias("module_id"), "series_id", a12.alias("A_12"), a24.alias("A_24"), signed("phase_12").alias("phi_12"), signed("phase_24").alias("phi_24"), label.alias("classification"), (a12 > 0.1).alias("f_test_12h_significant"), (F.col("amp_8") - F.col("amp_6")).alias("T_12_deviation"))


@query(_MOD + f", g AS (SELECT module_id, count(*) AS n, sqrt(pow(avg(cos(phi_12)), 2) + pow(avg(sin(phi_12)), 2)) AS r FROM md GROUP BY 1) SELECT module_id, n, {I.q6('r', 'r')}, {I.q6('least(1.0, exp(sqrt(1 + 4.0*n + 4 * (1.0*n*n - n*r*r)) - (1 + 2.0*n)))', 'p_value')} FROM g")
def module_coherence(spark, d):
    r = network.phase_coherence(_moduled(spark, d))
    return r.select("module_id", "n", I.r6(F.col("r"), "r"), I.r6(F.col("p_value"), "p_value"))


@query(_MOD + f", c AS (SELECT module_id, classification, count(*) AS k FROM md GROUP BY 1, 2), t AS (SELECT c.*, sum(k) OVER (PARTITION BY module_id)::BIGINT AS dr, sum(k) OVER (PARTITION BY classification)::BIGINT AS mk, sum(k) OVER ()::BIGINT AS tt FROM c), j AS (SELECT t.*, unnest(generate_series(greatest(k, dr + mk - tt), least(mk, dr))) AS j FROM t), p AS (SELECT module_id, classification, any_value(dr) AS n, any_value(k) AS k, least(1.0, sum({_pmf('j')})) AS p FROM j GROUP BY 1, 2) SELECT module_id, n, k, classification AS label, {I.q6('p', 'p_value')} FROM p QUALIFY row_number() OVER (PARTITION BY module_id ORDER BY p, classification) = 1")
def module_enrichment(spark, d):
    r = network.enrichment(_moduled(spark, d))
    return r.select("module_id", "n", "k", "label", I.r6(F.col("p_value"), "p_value"))


_HYP = "SELECT module_id, count(*) AS n_series, avg(A_12) AS mu, greatest(coalesce(stddev_samp(A_12), 1), 1e-8) AS sg, atan2(avg(sin(phi_12)), avg(cos(phi_12))) AS mp, sqrt(pow(avg(sin(phi_12)), 2) + pow(avg(cos(phi_12)), 2)) AS r, avg(CASE WHEN classification IN ('independent_ultradian', 'likely_independent_ultradian') THEN 1.0 ELSE 0.0 END) AS pi_, avg(CASE WHEN f_test_12h_significant THEN 1.0 ELSE 0.0 END) AS pr FROM md GROUP BY 1 HAVING count(*) >= 5"
_KAPPA = "CASE WHEN r < 1e-10 THEN 0 ELSE least(500.0, CASE WHEN r >= 0.85 THEN 1 / (2*(1-r) - (1-r)*(1-r)) ELSE r*(2 - r*r)/(1 - r*r) END) END"


@query(_MOD + f", h AS ({_HYP}) SELECT module_id, n_series, {I.q6('mu', 'mu_A_12')}, {I.q6('sg', 'sigma_A_12')}, {I.q6('mp', 'mu_phi_12')}, {I.q6(_KAPPA, 'kappa_phi_12')}, {I.q6('pi_', 'prop_independent')}, {I.q6('pr', 'prop_rhythmic')} FROM h")
def module_hyperparameters(spark, d):
    h = network.hyperparameters(_moduled(spark, d))
    return h.select("module_id", "n_series", *[I.r6(F.col(c), c) for c in ("mu_A_12", "sigma_A_12", "mu_phi_12", "kappa_phi_12", "prop_independent", "prop_rhythmic")])


@query(_MOD + f", h AS ({_HYP}), z AS (SELECT coalesce(quantile_cont(CASE WHEN T_12_deviation > 0 THEN T_12_deviation END, 0.5), 1) AS mid FROM md), j AS (SELECT md.*, h.*, CASE WHEN T_12_deviation > 0 THEN T_12_deviation ELSE mid END AS sd FROM md JOIN h USING (module_id), z) SELECT series_id, {I.q6('sg*sg/(sg*sg + sd*sd) * A_12 + (1 - sg*sg/(sg*sg + sd*sd)) * mu', 'A_12_shrunk')}, {I.q6('sg*sg/(sg*sg + sd*sd)', 'shrinkage_weight_A12')} FROM j")
def shrinkage(spark, d):
    m = _moduled(spark, d)
    s = network.shrink(m, network.hyperparameters(m))
    return s.select("series_id", I.r6(F.col("A_12_shrunk"), "A_12_shrunk"), I.r6(F.col("shrinkage_weight_A12"), "shrinkage_weight_A12"))


_SHARE = "g AS (SELECT module_id, count(*) AS n, count_if(classification <> 'ambiguous') AS kn, count_if(classification LIKE '%independent%') AS ki, count_if(classification = 'harmonic') AS kh FROM md GROUP BY 1)"


@query(_MOD + f", {_SHARE} SELECT series_id, CASE WHEN classification = 'ambiguous' AND n >= 5 AND kn > 0 AND ki / kn > 0.54 THEN 'likely_independent' WHEN classification = 'ambiguous' AND n >= 5 AND kn > 0 AND kh / kn > 0.54 THEN 'likely_harmonic' ELSE classification END AS hierarchical_classification FROM md JOIN g USING (module_id)")
def hierarchical_reclassification(spark, d):
    return network.reclassify(_moduled(spark, d)).select("series_id", "hierarchical_classification")


@query()
def refine_ambiguous(spark, d):
    m = _moduled(spark, d)
    return network.refine(m, network.enrichment(m)).select("series_id", "module_id", "refined")


@query("WITH c AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal END AS a FROM supplier), m AS (SELECT quantile_cont(a, 0.5) AS mid FROM c) SELECT s_suppkey, " + I.q6("coalesce(a, mid)", "a") + " FROM c, m")
def impute_median(spark, d):
    s = I.table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("a"))
    return network.impute_median(s, ["a"]).select("s_suppkey", I.r6(F.col("a"), "a"))


@query()
def ward_modules(spark, d):
    m = _moduled(spark, d).withColumn("log_bf", F.col("A_12") - F.col("A_24")).drop("module_id")
    return network.modules(network.features(m))


@query()
def spectral_modules(spark, d):
    m = _moduled(spark, d).withColumn("log_bf", F.col("A_12") - F.col("A_24")).drop("module_id")
    return network.modules(network.features(m), 8, "spectral")


@query()
def bisecting_modules(spark, d):
    m = _moduled(spark, d).withColumn("log_bf", F.col("A_12") - F.col("A_24")).drop("module_id")
    return network.modules(network.features(m), 8, "bisecting")


@query()
def hierarchical_refinement(spark, d):
    m = _moduled(spark, d).withColumn("log_bf", F.col("A_12") - F.col("A_24")).drop("module_id")
    return network.hierarchical(m, method="bisecting")


# --- metrics -----------------------------------------------------------------------------------------------------

_LAB = "SELECT l.doc_id, CAST(l.quality AS VARCHAR) AS y_true, CASE WHEN d.n_chars > 1000 THEN '1' ELSE '0' END AS y_pred, l.quality = 1 AS truth, d.n_chars AS score, d.lang, d.n_chars % 97 AS other FROM labels l JOIN documents d USING (doc_id)"


def _labelled(spark, d):
    j = I.table(spark, d, "labels").join(I.table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return j.select(F.col("doc_id"), F.col("quality").cast("string").alias("y_true"), F.when(F.col("n_chars") > 1000, "1").otherwise("0").alias("y_pred"), (F.col("quality") == 1).alias("truth"), F.col("n_chars").alias("score"), "lang", (F.col("n_chars") % 97).alias("other"))


@query(f"SELECT lang, y_true, y_pred, count(*) AS n FROM ({_LAB}) GROUP BY ALL")
def confusion_matrix(spark, d):
    return metrics.confusion(_labelled(spark, d), ["lang"])


_PER = f"WITH x AS ({_LAB}), l AS (SELECT DISTINCT lang, y_true AS label FROM x UNION SELECT DISTINCT lang, y_pred FROM x), c AS (SELECT l.lang, l.label, count_if(y_true = label) AS t, count_if(y_pred = label) AS p, count_if(y_true = label AND y_pred = label) AS h FROM l JOIN x ON x.lang = l.lang GROUP BY 1, 2), s AS (SELECT *, CASE WHEN p > 0 THEN h / p ELSE 0 END AS pr, CASE WHEN t > 0 THEN h / t ELSE 0 END AS re FROM c), f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM s)"


@query(_PER + f" SELECT lang, label, t AS support, {I.q6('pr', 'precision')}, {I.q6('re', 'recall')}, {I.q6('f1', 'f1')} FROM f")
def per_label_scores(spark, d):
    p = metrics.per_label(_labelled(spark, d), ["lang"])
    return p.select("lang", "label", F.col("support").cast("long").alias("support"), *[I.r6(F.col(c), c) for c in ("precision", "recall", "f1")])


@query(_PER + f", a AS (SELECT lang, count(*) AS n, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS acc FROM x GROUP BY 1) SELECT lang, any_value(n) AS n, {I.q6('any_value(acc)', 'accuracy')}, {I.q6('avg(pr)', 'macro_precision')}, {I.q6('avg(re)', 'macro_recall')}, {I.q6('avg(f1)', 'macro_f1')} FROM f JOIN a USING (lang) GROUP BY lang")
def classification_scores(spark, d):
    r = metrics.scores(_labelled(spark, d), ["lang"])
    return r.select("lang", "n", *[I.r6(F.col(c), c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1")])


@query(f"WITH g AS (SELECT lang, count_if(truth AND y_pred = '1') AS tp, count_if(NOT truth AND y_pred = '1') AS fp, count_if(NOT truth AND y_pred = '0') AS tn, count_if(truth AND y_pred = '0') AS fn FROM ({_LAB}) GROUP BY 1) SELECT lang, tp, fp, tn, fn, {I.q6('(tp + tn) / (tp + fp + tn + fn)', 'accuracy')}, {I.q6('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END', 'sensitivity')}, {I.q6('CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END', 'specificity')} FROM g")
def binary_scores(spark, d):
    r = metrics.binary(_labelled(spark, d), F.col("truth"), F.col("y_pred") == "1", ["lang"])
    return r.select("lang", "tp", "fp", "tn", "fn", *[I.r6(F.col(c), c) for c in ("accuracy", "sensitivity", "specificity")])


_AUC = "(SELECT (sum(rk) FILTER (truth) - count_if(truth) * (count_if(truth) + 1) / 2.0) / nullif(CAST(count_if(truth) AS DOUBLE) * count_if(NOT truth), 0) FROM r)"


@query(f"WITH r AS (SELECT lang, truth, (2 * rank() OVER (PARTITION BY lang ORDER BY score) + count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS rk FROM ({_LAB})), g AS (SELECT lang, count_if(truth) AS p, count_if(NOT truth) AS q, sum(CASE WHEN truth THEN rk ELSE 0 END) AS s FROM r GROUP BY 1) SELECT lang, {I.q6('CASE WHEN p > 0 AND q > 0 THEN (CAST(s AS DOUBLE) - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * q) END', 'auc')} FROM g")
def roc_auc(spark, d):
    return metrics.auc(_labelled(spark, d), F.col("score"), F.col("truth"), ["lang"]).select("lang", I.r6(F.col("auc"), "auc"))


@query(f"WITH g AS (SELECT score AS threshold, count_if(truth) AS p, count_if(NOT truth) AS q FROM ({_LAB}) GROUP BY 1) SELECT CAST(threshold AS DOUBLE) AS threshold, {I.q6('CAST(sum(p) OVER w AS DOUBLE) / sum(p) OVER ()', 'tpr')}, {I.q6('CAST(sum(q) OVER w AS DOUBLE) / sum(q) OVER ()', 'fpr')} FROM g WINDOW w AS (ORDER BY threshold DESC)")
def roc_curve(spark, d):
    r = metrics.roc_points(_labelled(spark, d), F.col("score"), F.col("truth"))
    return r.select("threshold", I.r6(F.col("tpr"), "tpr"), I.r6(F.col("fpr"), "fpr"))


@query(f"WITH g AS (SELECT lang, count_if(y_true = y_pred AND NOT (truth = (other > 48))) AS b, count_if(y_true <> y_pred AND truth = (other > 48)) AS c FROM ({_LAB}) GROUP BY 1), k AS (SELECT g.*, unnest(generate_series(0, least(b, c))) AS j FROM g), s AS (SELECT lang, any_value(b) AS b, any_value(c) AS c, sum(exp(lgamma(b + c + 1.0) - lgamma(j + 1.0) - lgamma(b + c - j + 1.0) - (b + c) * ln(2))) AS tail FROM k GROUP BY 1) SELECT lang, b, c, {I.q6('CASE WHEN b + c = 0 THEN 1 WHEN b + c < 25 THEN least(1.0, 2 * tail) END', 'p_exact')} FROM s")
def mcnemar(spark, d):
    x = _labelled(spark, d)
    r = metrics.mcnemar(x, F.col("y_true") == F.col("y_pred"), F.col("truth") == (F.col("other") > 48), ["lang"])
    return r.select("lang", "b", "c", I.r6(F.when(F.col("b") + F.col("c") < 25, F.col("p_value")), "p_exact"))


def _delong_sql() -> str:
    place = ", ".join(f"(SELECT avg(CASE WHEN n.{s} < x.{s} THEN 1.0 WHEN n.{s} = x.{s} THEN 0.5 ELSE 0.0 END) FROM x n WHERE n.truth <> x.truth) AS {v}" for s, v in (("score", "va"), ("other", "vb")))
    var = lambda k: f"(SELECT var_samp(va) + var_samp(vb) - 2 * covar_samp(va, vb) FROM p WHERE {k}) / (SELECT count(*) FROM p WHERE {k})"
    return f"WITH x AS ({_LAB}), p AS (SELECT x.truth, {place} FROM x), a AS (SELECT avg(va) AS a, avg(vb) AS b FROM p WHERE truth) SELECT {I.q6('a', 'auc_a')}, {I.q6('b', 'auc_b')}, {I.q6('(a - b) / sqrt(' + var('truth') + ' + ' + var('NOT truth') + ')', 'z')} FROM a"


@query(_delong_sql())
def delong(spark, d):
    r = metrics.delong(_labelled(spark, d), "score", "other", F.col("truth"), "doc_id")
    return r.select(*[I.r6(F.col(c), c) for c in ("auc_a", "auc_b", "z")])


_ERR = "SELECT l_returnflag, abs(l_quantity - 25) AS pe, abs(l_extendedprice - l_tax * 100000) / CASE WHEN l_tax = 0 THEN 1 ELSE abs(l_tax * 100000) END AS ae, abs((l_quantity - l_discount) - 2 * pi() * floor((l_quantity - l_discount) / (2 * pi()))) AS w FROM lineitem"


@query(f"WITH e AS (SELECT l_returnflag, pe, ae, CASE WHEN w > pi() THEN 2 * pi() - w ELSE w END AS fe FROM ({_ERR})) SELECT l_returnflag, count(*) AS n, {I.q6('avg(pe)', 'period_mean')}, {I.q6('quantile_cont(pe, 0.5)', 'period_median')}, {I.q6('stddev_pop(pe)', 'period_sd')}, {I.q6('quantile_cont(ae, 0.5)', 'amplitude_median')}, {I.q6('avg(fe)', 'phase_mean')} FROM e GROUP BY 1")
def parameter_errors(spark, d):
    li = I.table(spark, d, "lineitem")
    x = li.select("l_returnflag", F.col("l_quantity").alias("period"), F.lit(25.0).alias("true_period"), F.col("l_extendedprice").alias("amplitude"), (F.col("l_tax") * 100000).alias("true_amplitude"), F.col("l_quantity").alias("phase"), F.col("l_discount").alias("true_phase"))
    r = metrics.parameter_errors(x, ["l_returnflag"])
    return r.select("l_returnflag", "n", *[I.r6(F.col(c), c) for c in ("period_mean", "period_median", "period_sd", "amplitude_median", "phase_mean")])


@query("SELECT event_type, " + ", ".join([I.q6("avg(value) FILTER (value > 0)", "mean_ms"), I.q6("quantile_cont(value, 0.5) FILTER (value > 0)", "median_ms"), I.q6("stddev_pop(value) FILTER (value > 0)", "sd_ms"), I.q6("quantile_cont(value, 0.95) FILTER (value > 0)", "p95_ms")]) + ", count(*) FILTER (value > 0) AS n FROM events GROUP BY 1")
def latency_summary(spark, d):
    r = metrics.latency(I.table(spark, d, "events"), F.col("value"), ["event_type"])
    return r.select("event_type", *[I.r6(F.col(c), c) for c in ("mean_ms", "median_ms", "sd_ms", "p95_ms")], "n")


@query("SELECT c_mktsegment, count(*) AS n, count_if(c_acctbal > 0) AS n_detected, " + I.q6("avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END)", "rate") + " FROM customer GROUP BY 1")
def recovery_rates(spark, d):
    r = metrics.recovery(I.table(spark, d, "customer"), ["c_mktsegment"], F.col("c_acctbal") > 0)
    return r.select("c_mktsegment", "n", "n_detected", I.r6(F.col("rate"), "rate"))


def _agreement(a, b, rows):
    import numpy as np

    return float(np.average(a == b, weights=rows))


@query()
def bootstrap_accuracy(spark, d):
    return metrics.bootstrap_metric(_labelled(spark, d), _agreement)


@query()
def permutation_accuracy(spark, d):
    x = _labelled(spark, d).withColumn("y_b", F.when(F.col("other") > 48, "1").otherwise("0"))
    return metrics.permutation_metric(x, _agreement, "y_pred", "y_b")


@query()
def cross_validation(spark, d):
    return metrics.cross_validate(_labelled(spark, d).withColumnRenamed("doc_id", "series_id"))


@query()
def compare_methods(spark, d):
    x = _labelled(spark, d).withColumnRenamed("doc_id", "series_id")
    rows = [x.select("series_id", F.lit(m).alias("method"), "y_true", p.cast("string").alias("y_pred")) for m, p in (("rule", F.col("y_pred")), ("digit", (F.col("other") > 48).cast("int")), ("all", F.lit(1)))]
    return metrics.compare_methods(rows[0].unionByName(rows[1]).unionByName(rows[2]), "rule")


# --- ensemble ----------------------------------------------------------------------------------------------------

_NAMES = ("independent_ultradian", "likely_independent_ultradian", "harmonic", "circadian_only", "non_rhythmic", "ambiguous", "damped_ultradian")


def _pick(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END"


def _canon(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = '{k}' THEN '{v}'" for k, v in ensemble.CANONICAL.items()) + f" ELSE {x} END"


_VOTES = f"SELECT o_orderkey, {_pick('o_orderkey % 8')} AS la, {_pick('o_custkey % 8')} AS lb, 1 / (1 + exp(-abs((o_orderkey % 50) / 10.0))) AS ca, (o_custkey % 100) / 100.0 AS cb FROM orders"
_RULES = [
    ("la IS NULL AND lb IS NULL", "'ambiguous'", "0.0", 0, 1), ("la IS NULL", "lb", "cb", 0, 1), ("lb IS NULL", "la", "ca", 0, 1),
    ("la = lb", "la", "0.4*ca + 0.6*cb", 1, 0), ("a = b", "lb", "0.4*ca + 0.6*cb", 1, 0),
    ("la = 'non_rhythmic' AND cb > 0.9", "lb", "cb * 0.8", 0, 1), ("la = 'non_rhythmic'", "la", "ca", 0, 1),
    ("b = 'non_rhythmic' AND ca > 0.6", "la", "ca", 0, 1), ("b = 'non_rhythmic'", "lb", "cb", 0, 1),
    ("la = 'ambiguous'", "lb", "cb", 0, 0), ("lb = 'ambiguous'", "la", "ca", 0, 0),
    ("(a = 'harmonic' AND b = 'independent') OR (a = 'independent' AND b = 'harmonic')", "CASE WHEN 0.6*cb >= 0.4*ca THEN lb ELSE la END", "greatest(0.6*cb, 0.4*ca)", 0, 1),
    ("la = 'harmonic' AND b = 'circadian'", "la", "ca", 0, 1),
    ("TRUE", "CASE WHEN 0.6*cb >= 0.4*ca THEN lb ELSE la END", "greatest(0.6*cb, 0.4*ca)", 0, 1),
]


def _ladder(i: int, f=lambda x: x) -> str:
    return "CASE " + " ".join(f"WHEN {r[0]} THEN {f(r[i])}" for r in _RULES) + " END"


@query(f"WITH v AS ({_VOTES}), w AS (SELECT *, {_canon('la')} AS a, {_canon('lb')} AS b FROM v) SELECT CAST(o_orderkey AS VARCHAR) AS series_id, {_ladder(1)} AS consensus_classification, {I.q6(_ladder(2), 'consensus_confidence')}, {_ladder(3, lambda x: 'TRUE' if x else 'FALSE')} AS agreement, {_ladder(4, lambda x: 'TRUE' if x else 'FALSE')} AS review_flag FROM w")
def weighted_vote(spark, d):
    o = I.table(spark, d, "orders")
    pick = lambda c: F.get(F.lit(list(_NAMES)), c.cast("int"))
    ca, cb = S.logistic(F.abs(F.col("o_orderkey") % 50 / 10)), F.col("o_custkey") % 100 / 100
    v = ensemble.vote(pick(F.col("o_orderkey") % 8), pick(F.col("o_custkey") % 8), ca, cb, 0.4, 0.6)
    return o.select(F.col("o_orderkey").cast("string").alias("series_id"), v["consensus_classification"].alias("consensus_classification"), I.r6(v["consensus_confidence"], "consensus_confidence"), v["agreement"].alias("agreement"), v["review_flag"].alias("review_flag"))


def _two_tables(spark, d):
    o = I.table(spark, d, "orders")
    pick = lambda c: F.get(F.lit(list(_NAMES)), c.cast("int"))
    key = F.col("o_orderkey").cast("string").alias("series_id")
    a = o.where("o_orderstatus <> 'F'").select(key, pick(F.col("o_orderkey") % 7).alias("classification"), (F.col("o_orderkey") % 50 / 10).alias("log_bf"))
    b = o.where("o_orderpriority <> '1-URGENT'").select(key, pick(F.col("o_custkey") % 7).alias("classification"), (F.col("o_custkey") % 100 / 100).alias("confidence"))
    return a, b


@query(f"WITH a AS (SELECT o_orderkey, {_pick('o_orderkey % 7')} AS la, 1 / (1 + exp(-(o_orderkey % 50) / 10.0)) AS ca FROM orders WHERE o_orderstatus <> 'F'), b AS (SELECT o_orderkey, {_pick('o_custkey % 7')} AS lb, (o_custkey % 100) / 100.0 AS cb FROM orders WHERE o_orderpriority <> '1-URGENT'), v AS (SELECT CAST(coalesce(a.o_orderkey, b.o_orderkey) AS VARCHAR) AS series_id, la, lb, ca, cb FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey), w AS (SELECT *, {_canon('la')} AS a, {_canon('lb')} AS b FROM v) SELECT series_id, {_ladder(1)} AS consensus_classification, {_ladder(3, lambda x: 'TRUE' if x else 'FALSE')} AS agreement FROM w")
def integrate_results(spark, d):
    return ensemble.integrate(*_two_tables(spark, d)).select("series_id", "consensus_classification", "agreement")


@query()
def learn_weights(spark, d):
    a, b = _two_tables(spark, d)
    truth = a.select("series_id", F.col("classification").alias("label"))
    return ensemble.learn_weights(a, b, truth)


# --- relational --------------------------------------------------------------------------------------------------


@query("SELECT s_suppkey, s_name AS a_s_name, s_acctbal AS a_s_acctbal, s_nationkey AS a_s_nationkey FROM supplier")
def prefixed_columns(spark, d):
    s = I.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey")
    return relational.prefixed(s, "a", ["s_suppkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_totalprice < 1000")
def label_filter(spark, d):
    return I.table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") | (F.col("o_totalprice") < 1000)).select("o_orderkey")


@query(f"WITH m AS (SELECT series_id, avg(y) AS mean FROM ({I.POINTS_SQL}) GROUP BY 1), c AS (SELECT quantile_cont(mean, 0.25) AS cut FROM m) SELECT series_id FROM m, c WHERE mean >= cut")
def expression_prefilter(spark, d):
    return relational.expressed(I.vectors(spark, d), percentile=0.25).select("series_id")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'screened_in' ELSE 'non_rhythmic' END AS classification FROM orders")
def prescreened(spark, d):
    o = I.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return relational.screened(o, F.col("o_totalprice") > 100000, lambda x: x.withColumn("classification", F.lit("screened_in"))).select("o_orderkey", "classification")


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS n_orders, b.acct FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT c_custkey AS k, " + I.q6("c_acctbal", "acct") + " FROM customer WHERE c_acctbal > 0) b ON a.k = b.k")
def full_join(spark, d):
    a = I.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_orders"))
    b = I.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), I.r6(F.col("c_acctbal"), "acct"))
    return a.join(b, "k", "full")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def anti_join(spark, d):
    o = I.table(spark, d, "orders").where("o_totalprice > 200000")
    return I.table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_join(spark, d):
    o = I.table(spark, d, "orders").where("o_totalprice > 200000")
    return I.table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("WITH m AS (SELECT n_name, 'circadian' AS c, 1 AS r FROM nation WHERE n_regionkey < 3 UNION ALL SELECT n_name, 'known_12h', 0 FROM nation WHERE n_name > 'I'), b AS (SELECT upper(n_name) AS s, arg_min(c, r) AS truth FROM m GROUP BY 1) SELECT n_nationkey, truth FROM nation LEFT JOIN b ON upper(n_name) = s")
def ground_truth(spark, d):
    n = I.table(spark, d, "nation")
    lists = n.where("n_regionkey < 3").select(F.lower("n_name").alias("symbol"), F.lit("circadian").alias("category")).unionByName(n.where("n_name > 'I'").select(F.col("n_name").alias("symbol"), F.lit("known_12h").alias("category")))
    return relational.truth_of(n.withColumnRenamed("n_name", "symbol"), lists).select("n_nationkey", "truth")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def dedup_max_mean(spark, d):
    return relational.dedup_max_mean(I.table(spark, d, "orders"), "o_custkey", F.col("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(spark, d):
    return relational.top_k(I.table(spark, d, "orders"), 20, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderkey", "o_totalprice")


@query(f"WITH v AS ({_VOTES}), w AS (SELECT o_orderkey, {_canon('la')} AS a, {_canon('lb')} AS b FROM v) SELECT o_orderkey, CASE WHEN a = 'independent' AND b = 'independent' THEN 'independent_in_both' WHEN a = 'independent' AND b = 'harmonic' THEN 'independent_to_harmonic' WHEN a = 'harmonic' AND b = 'independent' THEN 'harmonic_to_independent' WHEN a = 'independent' THEN 'lost_independent' WHEN b = 'independent' THEN 'gained_independent' WHEN a = 'harmonic' AND b = 'harmonic' THEN 'harmonic_in_both' WHEN a = 'non_rhythmic' AND b = 'non_rhythmic' THEN 'non_rhythmic_in_both' ELSE 'other' END AS change FROM w")
def condition_change(spark, d):
    pick = lambda c: F.get(F.lit(list(_NAMES)), c.cast("int"))
    return I.table(spark, d, "orders").select("o_orderkey", relational.condition_change(pick(F.col("o_orderkey") % 8), pick(F.col("o_custkey") % 8)).alias("change"))


@query("SELECT CASE WHEN q AND l THEN 'both' WHEN NOT q AND NOT l THEN 'neither' WHEN q THEN 'ours_only' ELSE 'theirs_only' END AS concordance, count(*) AS n FROM (SELECT l.quality = 1 AS q, d.n_chars > 1000 AS l FROM labels l JOIN documents d USING (doc_id)) GROUP BY 1")
def concordance(spark, d):
    x = _labelled(spark, d).select(relational.concordance(F.col("truth"), F.col("y_pred") == "1").alias("concordance"))
    return relational.value_counts(x, "concordance")


@query("SELECT l_orderkey, l_linenumber, " + I.q6("log2((l_quantity + 1e-6) / (l_discount + 1e-6))", "log2fc") + " FROM lineitem")
def log2_fold_change(spark, d):
    return I.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", I.r6(S.log2_fold_change(F.col("l_quantity"), F.col("l_discount")), "log2fc"))


@query("SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN n END) AS f, max(CASE WHEN o_orderstatus = 'O' THEN n END) AS o, " + I.q6("(coalesce(max(CASE WHEN o_orderstatus = 'F' THEN n END), 0) + coalesce(max(CASE WHEN o_orderstatus = 'O' THEN n END), 0)) / nullif(max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) + max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END), 0)", "mean") + " FROM (SELECT o_custkey, o_orderstatus, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def pivot_table(spark, d):
    o = I.table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").cast("double").alias("n"))
    p = relational.pivot_first(o, "o_custkey", "o_orderstatus", "n", ["F", "O"])
    return p.select("o_custkey", F.col("F").alias("f"), F.col("O").alias("o"), I.r6(F.col("mean"), "mean"))


@query(f"SELECT la AS before, lb AS after, count(*) AS n FROM ({_VOTES}) GROUP BY ALL")
def transition_matrix(spark, d):
    o = I.table(spark, d, "orders")
    pick = lambda c: F.get(F.lit(list(_NAMES)), c.cast("int"))
    a = o.select(F.col("o_orderkey").alias("series_id"), pick(F.col("o_orderkey") % 8).alias("classification"))
    b = o.select(F.col("o_orderkey").alias("series_id"), pick(F.col("o_custkey") % 8).alias("classification"))
    return relational.transitions(a, b)


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS n_groups FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 3")
def conserved_keys(spark, d):
    return relational.conserved(I.table(spark, d, "lineitem"), "l_partkey", "l_suppkey", 3).select("l_partkey", F.col("n_groups").cast("long").alias("n_groups"))


@query("SELECT user_id, count(DISTINCT event_type) FILTER (value > 50) AS n_detected, count(DISTINCT event_type) FILTER (value > 50) > 0 AS in_any, count(DISTINCT event_type) FILTER (value > 50) = (SELECT count(DISTINCT event_type) FROM events) AS in_all FROM events GROUP BY 1")
def cross_group_coverage(spark, d):
    return relational.coverage(I.table(spark, d, "events"), "user_id", "event_type", F.col("value") > 50)


@query("SELECT n_name AS pathway, count(*) AS n, count_if(s_acctbal > 0) AS n_first, count_if(s_acctbal > 1000) AS n_second, count_if(s_acctbal > 5000) AS n_second_independent FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def pathway_counts(spark, d):
    s = I.table(spark, d, "supplier").select(F.col("s_nationkey").alias("symbol"), (F.col("s_acctbal") > 0).alias("first_12h"), (F.col("s_acctbal") > 1000).alias("second_12h"), (F.col("s_acctbal") > 5000).alias("second_independent"))
    p = I.table(spark, d, "nation").select(F.col("n_nationkey").alias("symbol"), F.col("n_name").alias("pathway"))
    return relational.pathway_counts(s, p)


@query("WITH g AS (SELECT l_returnflag, count_if(l_linestatus = 'O') AS b, count_if(l_linestatus = 'F') AS a FROM lineitem GROUP BY 1) SELECT l_returnflag, CAST(trunc(100 * (1 - CAST(a AS DOUBLE) / greatest(b, 1))) AS INTEGER) AS reduction FROM g")
def percent_reduction(spark, d):
    g = I.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "O").alias("b"), F.count_if(F.col("l_linestatus") == "F").alias("a"))
    return g.select("l_returnflag", relational.percent_reduction(F.col("b"), F.col("a")).alias("reduction"))


@query(f"WITH v AS ({_VOTES}) SELECT CAST(o_orderkey AS VARCHAR) AS series_id, ca > 0.9 AND NOT cb > 0.9 AS circadian_disrupted, ca > 0.5 AND cb > 0.5 AS persists_12h FROM v")
def knockout_table(spark, d):
    o = I.table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string").alias("series_id")
    pick = lambda c: F.get(F.lit(list(_NAMES)), c.cast("int"))
    ca, cb = S.logistic(F.abs(F.col("o_orderkey") % 50 / 10)), F.col("o_custkey") % 100 / 100
    p = lambda c, cut: F.when(c > cut, 0.01).otherwise(0.5)
    a = o.select(key, p(ca, 0.9).alias("p_24"), p(ca, 0.5).alias("p_12"), pick(F.col("o_orderkey") % 8).alias("classification"))
    b = o.select(key, p(cb, 0.9).alias("p_24"), p(cb, 0.5).alias("p_12"), pick(F.col("o_custkey") % 8).alias("classification"))
    return relational.knockout_table(a, b).select("series_id", "circadian_disrupted", "persists_12h")


@query("WITH t AS (SELECT l_returnflag AS tissue, l_partkey AS symbol, CASE WHEN l_suppkey % 4 = 0 THEN 'harmonic' ELSE 'circadian_only' END AS classification FROM lineitem), c AS (SELECT symbol FROM t WHERE classification = 'harmonic' GROUP BY 1 HAVING count(DISTINCT tissue) >= 3) SELECT tissue, count(*) AS n, count_if(classification = 'harmonic') AS n_12h, count_if(symbol IN (SELECT symbol FROM c)) AS n_conserved, count_if(symbol IN (SELECT p_partkey FROM part WHERE p_size < 10)) AS n_marked FROM t GROUP BY 1")
def tissue_atlas(spark, d):
    li = I.table(spark, d, "lineitem").select("l_returnflag", F.col("l_partkey").alias("symbol"), F.when(F.col("l_suppkey") % 4 == 0, "harmonic").otherwise("circadian_only").alias("classification"))
    tables = {x: li.where(F.col("l_returnflag") == x).drop("l_returnflag") for x in ("A", "N", "R")}
    marks = I.table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("symbol"))
    return relational.atlas(tables, marks).groupBy("tissue").agg(F.count("*").alias("n"), F.count_if("is_12h").alias("n_12h"), F.count_if("is_conserved").alias("n_conserved"), F.count_if("is_marked").alias("n_marked"))


def _counted(sql: str) -> str:
    """count_if as a filtered count, whose type is that of a count."""
    while (i := sql.find("count_if(")) >= 0:
        j, depth = i + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        sql = f"{sql[:i]}count(*) FILTER ({sql[i + len('count_if(') : j - 1]}){sql[j:]}"
    return sql


SQL = {k: _counted(v) for k, v in SQL.items()}
