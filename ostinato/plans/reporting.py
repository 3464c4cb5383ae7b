"""Queries of decision rules over numbers of the orders' lines, of report tables, and of what readers do with names."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import validation
from ..operators import classify, detect, ensemble, evidence, reports
from ..sources import readers
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


#: Three numbers from 0 to 1, four labels and a flag of every line: the inputs of the rules.
_LABELS = ("independent_ultradian", "likely_independent_ultradian", "harmonic", "circadian_only", "non_rhythmic", "ambiguous")
_U = dict(enumerate(_LABELS, 1))
_V = {0: "independent_ultradian", 1: "harmonic", 2: "likely_independent_ultradian"}
_CASE = lambda c, m: f"CASE {c} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in m.items()) + " ELSE 'ambiguous' END"
_LINES = f"SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) / 50 AS a, CAST(l_discount AS DOUBLE) * 10 AS b, CAST(l_tax AS DOUBLE) * 12.5 AS c, l_returnflag = 'R' AS f, {_CASE('l_linenumber', _U)} AS u, {_CASE('l_partkey % 4', _V)} AS v FROM lineitem"


def _lines(spark, d):
    li = I.table(spark, d, "lineitem")
    num = lambda c: F.col(c).cast("double")
    pick = lambda c, m: F.coalesce(F.create_map(*[F.lit(x) for p in m.items() for x in p])[c.cast("int")], F.lit("ambiguous"))
    return li.select("l_orderkey", "l_linenumber", (num("l_quantity") / 50).alias("a"), (num("l_discount") * 10).alias("b"), (num("l_tax") * 12.5).alias("c"), (F.col("l_returnflag") == "R").alias("f"), pick(F.col("l_linenumber"), _U).alias("u"), pick(F.col("l_partkey") % 4, _V).alias("v"))


_KEY = ("l_orderkey", "l_linenumber")


def _ruled(select: str) -> str:
    return f"WITH x AS ({_LINES}) SELECT l_orderkey, l_linenumber, {select} FROM x"


@query(f"WITH x AS ({_LINES}), y AS (SELECT *, 1.2 + a AS ratio, abs(1.2 + a - 2) AS o, c / (1.2 + a) AS cv FROM x) SELECT l_orderkey, l_linenumber, CAST(CASE WHEN b > 0.8 AND o < 0.15 THEN -3 WHEN b > 0.6 AND o < 0.3 THEN -2 WHEN f AND o < 0.2 AND cv < 0.35 THEN -2 WHEN f AND o < 0.3 AND cv < 0.5 THEN -1 WHEN NOT f AND (b < 0.2 OR c > 0.5) THEN 2 WHEN o > 0.5 OR (cv > 0.5 AND o > 0.3) THEN 2 WHEN b < 0.4 AND o > 0.2 THEN 1 ELSE 0 END AS DOUBLE) AS score FROM y")
def coupling_scores(spark, d):
    s = F.struct(F.col("b").alias("corr"), (1.2 + F.col("a")).alias("ratio"), F.col("c").alias("ratio_sd"), F.col("f").alias("short"))
    return _lines(spark, d).select(*_KEY, evidence.coupling_score(s).alias("score"))


@query(_ruled("CAST((a > 0.3)::INT + (a > 0.6)::INT + (b / 20 > 0.02)::INT + (c / 20 > 0.03)::INT - (a < 0.1)::INT - (c / 20 < 0.02 AND a < 0.3)::INT AS DOUBLE) AS score"))
def mode_scores(spark, d):
    s = F.struct(F.col("a").alias("energy_ratio"), (F.col("b") / 20).alias("deviation"), (F.col("c") / 20).alias("lock"))
    return _lines(spark, d).select(*_KEY, evidence.vmd_score(s).alias("score"))


@query(_ruled("CAST(CASE WHEN a < 0.01 THEN -3 WHEN a < 0.05 THEN -2 WHEN a > 0.5 THEN 2 WHEN a > 0.2 THEN 1 ELSE 0 END AS DOUBLE) AS bispectral, CASE WHEN b < 0.01 THEN 'independent_ultradian' WHEN b < 0.05 THEN 'likely_independent_ultradian' WHEN b > 0.2 THEN 'harmonic' ELSE 'ambiguous' END AS lrt_label, CAST(CASE WHEN 2*a + c > 1.5 THEN 2 WHEN 2*a + c > 0.8 THEN 1 WHEN 2*a + c < 0.3 THEN -2 WHEN 2*a + c < 0.5 THEN -1 ELSE 0 END + CASE WHEN c > 0.5 THEN 1 WHEN c < 0.1 THEN -1 ELSE 0 END AS DOUBLE) AS divergence, round(least(-log10(greatest(b, 1e-20)) / 1.3, 1), 6) + 0.0 AS weight"))
def simulation_scores(spark, d):
    x = _lines(spark, d).withColumns({"kl": 2 * F.col("a"), "phase_div": F.col("c")})
    return x.select(*_KEY, evidence.bispectral_score(F.col("a")).alias("bispectral"), evidence.lrt_label(F.col("b")).alias("lrt_label"), evidence.divergence_score().alias("divergence"), I.r6(classify.weight_of_p(F.col("b")), "weight"))


_IND = "('independent_ultradian', 'likely_independent_ultradian')"
_FUSED = [("a < 0.01", "'harmonic'", "high", "bispectral_qpc_detected"), ("a < 0.05 AND u IN ('harmonic', 'circadian_only')", "u", "high", "bhct_confirms_v2_harmonic"), ("a < 0.05", "'harmonic'", "medium", "bhct_moderate_qpc"), (f"a > 0.5 AND u IN {_IND}", "u", "high", "bhct_confirms_v2_independent"), ("a > 0.5 AND u = 'circadian_only' AND b < 0.1", "'independent_ultradian'", "medium", "bhct_no_qpc_promotes_to_independent"), ("a > 0.5 AND u = 'circadian_only'", "u", "medium", "no_12h_signal"), ("a > 0.5", "u", "medium", "bhct_no_qpc_v2_default")]
_FCASE = lambda i, last: "CASE " + " ".join(f"WHEN {r[0]} THEN " + (r[i] if i == 1 else f"'{r[i]}'") for r in _FUSED) + f" ELSE {last} END"


@query(_ruled(f"{_FCASE(1, 'u')} AS label, {_FCASE(2, chr(39) + 'low' + chr(39))} AS confidence, {_FCASE(3, chr(39) + 'bhct_inconclusive_v2_default' + chr(39))} AS reason, (u = 'harmonic' AND a < 0.05) OR (u IN {_IND} AND a > 0.2) OR (u IN ('non_rhythmic', 'circadian_only') AND a >= 0.05) AS agree"))
def fusion_rules(spark, d):
    label, conf, reason = classify.fuse(F.col("u"), F.col("a"), F.col("b"))
    return _lines(spark, d).select(*_KEY, label.alias("label"), conf.alias("confidence"), reason.alias("reason"), classify.channels_agree(F.col("u"), F.col("a")).alias("agree"))


_KIN = lambda x: f"CASE WHEN {x} IN {_IND} THEN 'independent' WHEN {x} IN ('harmonic', 'circadian_only') THEN 'harmonic' ELSE {x} END"


@query(_ruled(f"CASE WHEN {_KIN('u')} = {_KIN('v')} OR u IN ('non_rhythmic', 'circadian_only') OR v = 'ambiguous' THEN u WHEN u = 'ambiguous' THEN v ELSE 'ambiguous' END AS label, CASE WHEN u = v THEN 'high' WHEN {_KIN('u')} = {_KIN('v')} THEN 'medium' ELSE 'low' END AS confidence"))
def label_agreement(spark, d):
    label, conf = classify.agree(F.col("u"), F.col("v"))
    return _lines(spark, d).select(*_KEY, label.alias("label"), conf.alias("confidence"))


def _points(s: str, *steps) -> str:
    return f"CASE {' '.join(f'WHEN {s} {op} {bound} THEN {score}' for op, bound, score in steps)} ELSE 0 END"


_BF = "exp(3 * a - 2)"
_COMMON = "(" + " + ".join([_points(_BF, (">", 3, 2), (">", 1, 1), ("<", 0.05, -2), ("<", 1, -1)), "CASE WHEN c / 10 > 0.05 THEN 3 WHEN c / 10 > 0.02 THEN 2 ELSE -1 END", _points("a", (">", 0.8, 3), (">", 0.65, 2), (">", 0.5, 1), ("<", 0.25, -2), ("<", 0.5, -1)), _points("b", (">", 0.35, 2), (">", 0.25, 1)), f"CASE WHEN f THEN 0 ELSE {_points('c', ('<', 0.01, 2), ('<', 0.05, 1), ('>', 0.5, -2), ('>', 0.3, -1))} END"]) + ")"


def _tree_inputs(spark, d):
    """Columns that the trees read: no free periods and too few points for a waveform, so that those lines are silent."""
    x = _lines(spark, d)
    none = F.array().cast("array<double>")
    return x.withColumns({"log_bf": 3 * F.col("a") - 2, "rel_dev": F.col("c") / 10, "amp_ratio": F.col("a"), "rss0": F.lit(1.0), "rss_free": 1 - F.col("b"), "p_lrt": F.when(~F.col("f"), F.col("c")), "t_free": none, "amp_free": none, "phi_free": none, "peak_phase": F.lit(0.0), "rise": F.lit(0.5), "n": F.lit(5), "tss": F.lit(2.0), "p_24": F.col("b"), "p_12": F.col("c"), "kl": 2 * F.col("a"), "phase_div": F.col("c"), "vmd": F.struct(F.col("a").alias("energy_ratio"), (F.col("b") / 20).alias("deviation"), (F.col("c") / 20).alias("lock"))})


@query(_ruled(f"CASE WHEN b >= 0.05 AND c >= 0.05 THEN 'non_rhythmic' WHEN b < 0.05 AND c >= 0.05 THEN 'circadian_only' WHEN b >= 0.05 THEN 'independent_ultradian' WHEN {_COMMON} >= 4 THEN 'independent_ultradian' WHEN {_COMMON} >= 2 THEN 'likely_independent_ultradian' WHEN {_COMMON} <= -2 THEN 'harmonic' ELSE 'ambiguous' END AS label"))
def hard_gated_tree(spark, d):
    return _tree_inputs(spark, d).select(*_KEY, classify.hard_gated().alias("label"))


_W = lambda p: f"least(-log10(greatest({p}, 1e-20)) / 1.3, 1)"
_MODES = "((a > 0.3)::INT + (a > 0.6)::INT + (b / 20 > 0.02)::INT + (c / 20 > 0.03)::INT - (a < 0.1)::INT - (c / 20 < 0.02 AND a < 0.3)::INT)"
_DIV = "(CASE WHEN 2*a + c > 1.5 THEN 2 WHEN 2*a + c > 0.8 THEN 1 WHEN 2*a + c < 0.3 THEN -2 WHEN 2*a + c < 0.5 THEN -1 ELSE 0 END + CASE WHEN c > 0.5 THEN 1 WHEN c < 0.1 THEN -1 ELSE 0 END)"
_SOFT = f"(CASE WHEN b < 1e-6 AND a < 0.4 THEN -2 WHEN b < 1e-4 AND a < 0.7 THEN -1.5 ELSE 0 END + ({_COMMON} + {_MODES} + {_DIV}) * {_W('c')} + CASE WHEN c < 0.01 THEN 1.5 WHEN c < 0.05 THEN 0.5 ELSE 0 END)"


@query(f"WITH x AS ({_LINES}), y AS (SELECT *, CASE WHEN b > 0.1 AND c > 0.1 THEN least({_SOFT}, 1) ELSE {_SOFT} END AS s FROM x) SELECT l_orderkey, l_linenumber, CASE WHEN b > 0.5 AND c > 0.5 THEN 'non_rhythmic' WHEN c > 0.5 AND a < 0.15 THEN 'circadian_only' WHEN b < 0.001 AND a < 0.3 THEN 'harmonic' WHEN b > 0.5 AND c < 0.05 THEN 'independent_ultradian' WHEN s >= 4.5 THEN 'independent_ultradian' WHEN s >= 2.5 THEN 'likely_independent_ultradian' WHEN s <= -2 THEN 'harmonic' WHEN {_W('b')} > 0.5 AND {_W('c')} < 0.5 AND s < 0 THEN 'circadian_only' ELSE 'ambiguous' END AS label FROM y")
def soft_gated_tree(spark, d):
    return _tree_inputs(spark, d).select(*_KEY, classify.soft_gated().alias("label"))


_P4 = ["a", "b", "c", "(a + b) / 2"]


@query(f"""WITH x AS ({_LINES}), y AS (SELECT *, CASE WHEN {' AND '.join(f'{p} >= 0.5' for p in _P4)} THEN 0.5 ELSE 0.5 - atan(({' + '.join(f'CASE WHEN {p} < 0.5 THEN tan((0.5 - greatest({p}, 1e-15)) * pi()) ELSE 0 END' for p in _P4)}) / ({' + '.join(f'({p} < 0.5)::INT' for p in _P4)})) / pi() END AS p, {' + '.join(f'({p} < 0.1)::INT' for p in _P4)} AS n FROM x),
z AS (SELECT *, p < 0.05 AND n >= 2 AND NOT (c > 0.5 AND p > 0.5) AS ok FROM y)
SELECT l_orderkey, l_linenumber, {I.q6('p', 'p_detect')}, CASE WHEN least(b, c) < 0.05 AND a > 0.10 THEN 'non_sinusoidal' WHEN a < 0.05 THEN 'sinusoidal' ELSE 'unknown' END AS waveform_hint, ok AS passed, CASE WHEN c > 0.5 AND p > 0.5 THEN 'non_rhythmic' WHEN c < 0.05 AND NOT ok THEN 'circadian_only' WHEN ok THEN 'has_12h' ELSE 'non_rhythmic' END AS stage1_class FROM z""")
def stage1_decisions(spark, d):
    x = _lines(spark, d).withColumns({"p_ftest": F.col("a"), "p_jtk": F.col("b"), "p_rain": F.col("c"), "p_harmreg": (F.col("a") + F.col("b")) / 2, "p_24": F.col("c"), "p_phase_freedom": F.col("a")})
    return detect.stage1_rules(x, F.lit(48)).select(*_KEY, I.r6(F.col("p_detect"), "p_detect"), "waveform_hint", "passed", "stage1_class")


@query(_ruled("coalesce(CASE WHEN f THEN a END, CASE WHEN b > 0.5 THEN b END, c) AS value, round_even(a * 100 + b, 1) + 0.0 AS rounded"))
def merged_parameters(spark, d):
    x = _lines(spark, d).withColumns({"p": F.when(F.col("f"), F.col("a")), "q": F.when(F.col("b") > 0.5, F.col("b"))})
    return x.select(*_KEY, ensemble.merged_parameter("p", "q", "c").alias("value"), (F.bround(F.col("a") * 100 + F.col("b"), 1) + 0.0).alias("rounded"))


_TITLE = "CASE p_size % 4 WHEN 1 THEN 'Liver CT' || p_size || ' rep 1' WHEN 2 THEN 'Circadian time ' || p_size || 'h' WHEN 3 THEN 'sample ' || p_size ELSE 'no hour here.' END"


@query(f"WITH t AS (SELECT p_partkey, {_TITLE} AS title, p_brand || ' /// ' || p_name AS symbols FROM part) SELECT p_partkey, CAST(CASE WHEN regexp_matches(title, 'CT[0-9]+') THEN regexp_extract(title, 'CT([0-9]+)', 1) WHEN regexp_matches(title, '[Cc]ircadian +time +[0-9]+') THEN regexp_extract(title, '[Cc]ircadian +time +([0-9]+)', 1) WHEN regexp_matches(title, '[0-9]+ *$') THEN regexp_extract(title, '([0-9]+) *$', 1) END AS DOUBLE) AS hour, trim(string_split(symbols, '///')[1]) AS symbol FROM t")
def names_of_samples(spark, d):
    p = I.table(spark, d, "part")
    title = F.when(F.col("p_size") % 4 == 1, F.concat(F.lit("Liver CT"), F.col("p_size").cast("string"), F.lit(" rep 1"))).when(F.col("p_size") % 4 == 2, F.concat(F.lit("Circadian time "), F.col("p_size").cast("string"), F.lit("h"))).when(F.col("p_size") % 4 == 3, F.concat(F.lit("sample "), F.col("p_size").cast("string"))).otherwise("no hour here.")
    return p.select("p_partkey", readers.hour_of(title).alias("hour"), readers.first_symbol(F.concat_ws(" /// ", "p_brand", "p_name")).alias("symbol"))


# --- report tables -------------------------------------------------------------------------------------------------

_RESULTS = "SELECT 'm' || l_linenumber AS method, l_returnflag || l_linestatus AS scenario, l_quantity > 25 AS truth, l_discount > 0.05 AS positive, CAST(l_discount AS DOUBLE) AS score FROM lineitem"
_RATES = ", ".join(I.q6(e, n) for n, e in (("sensitivity", "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END"), ("specificity", "CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END"), ("precision", "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END"), ("f1", "CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END")))
_COUNTS = ", ".join(f"count(*) FILTER (truth = {t} AND positive = {p}) AS {n}" for n, t, p in (("tp", "true", "true"), ("fp", "false", "true"), ("tn", "false", "false"), ("fn", "true", "false")))
_SHOWN = ("sensitivity", "specificity", "precision", "f1")


def _results(spark, d):
    li = I.table(spark, d, "lineitem")
    return li.select(F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("method"), F.concat("l_returnflag", "l_linestatus").alias("scenario"), (F.col("l_quantity") > 25).alias("truth"), (F.col("l_discount") > 0.05).alias("positive"), F.col("l_discount").cast("double").alias("score"))


@query(f"WITH x AS ({_RESULTS}), g AS (SELECT scenario, method, {_COUNTS} FROM x GROUP BY 1, 2), r AS (SELECT scenario, method, truth, rank() OVER w + (count(*) OVER (PARTITION BY scenario, method, score) - 1) / 2.0 AS k FROM x WINDOW w AS (PARTITION BY scenario, method ORDER BY score)), s AS (SELECT scenario, method, sum(k) FILTER (truth) AS rs FROM r GROUP BY 1, 2) SELECT scenario, method, tp, fp, tn, fn, {_RATES}, {I.q6('(rs - (tp + fn) * (tp + fn + 1) / 2.0) / ((tp + fn) * (tn + fp))', 'roc_auc')} FROM g JOIN s USING (scenario, method) WHERE tp + fn > 0 AND tn + fp > 0")
def detection_by_dataset(spark, d):
    t = reports.detection_table(_results(spark, d), F.col("truth"), F.col("positive"), F.col("score"), ["scenario", "method"])
    return t.select("scenario", "method", "tp", "fp", "tn", "fn", *[I.r6(F.col(c), c) for c in (*_SHOWN, "roc_auc")])


@query(f"WITH x AS ({_RESULTS}), g AS (SELECT method, {_COUNTS} FROM x WHERE NOT (method IN ('m1', 'm3') AND scenario IN ('RF', 'AO')) GROUP BY 1) SELECT method, tp, fp, tn, fn, {_RATES} FROM g WHERE tp + fn > 0 AND tn + fp > 0")
def tier_one_table(spark, d):
    t = reports.tier_one(_results(spark, d), ("m1", "m3"), ("RF", "AO"))
    return t.select("method", "tp", "fp", "tn", "fn", *[I.r6(F.col(c), c) for c in _SHOWN])


@query(f"WITH x AS ({_LINES}), y AS (SELECT v AS method, f AS truth, u IN {_IND} AS positive FROM x WHERE f OR a > 0.5), g AS (SELECT method, {_COUNTS} FROM y GROUP BY 1) SELECT method, tp, fp, tn, fn, {_RATES} FROM g WHERE tp + fn > 0 AND tn + fp > 0")
def tier_two_table(spark, d):
    x = _lines(spark, d).select(F.col("v").alias("method"), F.col("f").alias("independent"), (F.col("a") > 0.5).alias("harmonic"), F.col("u").alias("classification"), F.col("b").alias("confidence"))
    return reports.tier_two(x).select("method", "tp", "fp", "tn", "fn", *[I.r6(F.col(c), c) for c in _SHOWN])


@query(f"SELECT scenario, method, count(*) AS n, {I.q6('avg(CASE WHEN truth = positive THEN 1.0 ELSE 0.0 END)', 'accuracy')} FROM ({_RESULTS}) GROUP BY 1, 2")
def accuracy_by_scenario(spark, d):
    return reports.accuracy_table(_results(spark, d), ["scenario", "method"]).select("scenario", "method", "n", I.r6(F.col("accuracy"), "accuracy"))


_AGREE = lambda c: I.q6(f"avg(CASE WHEN (c_acctbal > 4500) = ({c}) THEN 1.0 ELSE 0.0 END)", "agreement_rate")


@query(f"SELECT 'nation' AS method, count(*) AS n_common, {_AGREE('c_nationkey > 12')} FROM customer UNION ALL SELECT 'segment', count(*), {_AGREE(chr(39) + 'F' + chr(39) + ' < c_mktsegment')} FROM customer WHERE c_acctbal > 0")
def method_concordance(spark, d):
    c = I.table(spark, d, "customer")
    rows = [y.select("c_custkey", F.lit(m).alias("method"), p.alias("positive")) for m, p, y in (("balance", F.col("c_acctbal") > 4500, c), ("nation", F.col("c_nationkey") > 12, c), ("segment", F.col("c_mktsegment") > "F", c.where("c_acctbal > 0")))]
    return reports.agreement_table(rows[0].unionByName(rows[1]).unionByName(rows[2]), "balance", ["c_custkey"]).select("method", "n_common", I.r6(F.col("agreement_rate"), "agreement_rate"))


_WT = "CASE c_mktsegment WHEN 'BUILDING' THEN 'harmonic' WHEN 'AUTOMOBILE' THEN 'independent_ultradian' WHEN 'MACHINERY' THEN 'likely_independent_ultradian' ELSE 'ambiguous' END"
_LF = lambda x: f"lgamma(({x}) + 1.0)"
_HYP = f"exp({_LF('al + cl')} - {_LF('j')} - {_LF('al + cl - j')} + {_LF('ak + ck')} - {_LF('al + ak - j')} - {_LF('ck - al + j')} - {_LF('al + ak + cl + ck')} + {_LF('al + ak')} + {_LF('cl + ck')})"


@query(f"WITH x AS (SELECT {_WT} AS w, c_acctbal > 4500 AS k FROM customer), g AS (SELECT count(*) FILTER (w = 'harmonic' AND NOT k) AS al, count(*) FILTER (w = 'harmonic' AND k) AS ak, count(*) FILTER (w LIKE '%independent%' AND NOT k) AS cl, count(*) FILTER (w LIKE '%independent%' AND k) AS ck, count(*) FILTER (w = 'ambiguous' AND NOT k) AS ul, count(*) FILTER (w = 'ambiguous') AS un FROM x) SELECT {I.q6('al / (al + ak)', 'harmonic_loss_rate')}, {I.q6('ck / (cl + ck)', 'independent_retention_rate')}, {I.q6('ul / un', 'ambiguous_loss_rate')}, {I.q6('al * ck / (ak * cl)', 'fisher_odds_ratio')}, {I.q6(f'(SELECT sum({_HYP}) FROM (SELECT unnest(range(al, least(al + cl, al + ak) + 1)) AS j))', 'fisher_p_value')} FROM g")
def knockout_validation(spark, d):
    c = I.table(spark, d, "customer")
    w = F.when(F.col("c_mktsegment") == "BUILDING", "harmonic").when(F.col("c_mktsegment") == "AUTOMOBILE", "independent_ultradian").when(F.col("c_mktsegment") == "MACHINERY", "likely_independent_ultradian").otherwise("ambiguous")
    r = reports.knockout_validation(c.select(w.alias("wt_classification"), (F.col("c_acctbal") > 4500).alias("ko_has_12h")))
    return r.select(*[I.r6(F.col(x).cast("double"), x) for x in ("harmonic_loss_rate", "independent_retention_rate", "ambiguous_loss_rate", "fisher_odds_ratio", "fisher_p_value")])


@query()
def mean_intervals(spark, d):
    return reports.mean_intervals(I.table(spark, d, "customer"), F.col("c_acctbal"), ["c_mktsegment"])


_LABELS = "CASE c_mktsegment WHEN 'BUILDING' THEN 'harmonic' WHEN 'AUTOMOBILE' THEN 'independent_ultradian' WHEN 'MACHINERY' THEN 'likely_independent_ultradian' WHEN 'FURNITURE' THEN 'circadian_only' ELSE 'non_rhythmic' END"
_CATEGORY = "CASE WHEN o_orderpriority < '2' THEN 'known_12h' WHEN o_orderpriority < '4' THEN 'core_circadian' ELSE 'housekeeping' END"
_FLAGS = f"SELECT o_custkey AS k, max(CASE WHEN c = 'known_12h' THEN 1 ELSE 0 END) = 1 AS kn, max(CASE WHEN c = 'core_circadian' THEN 1 ELSE 0 END) = 1 AS co, max(CASE WHEN c = 'housekeeping' THEN 1 ELSE 0 END) = 1 AS no FROM (SELECT o_custkey, {_CATEGORY} AS c FROM orders WHERE o_totalprice > 250000) GROUP BY 1"


def _validated(spark, d):
    """Customers as labelled symbols, and the lists that their large orders put them in."""
    c = I.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("symbol"), F.expr(_LABELS).alias("classification"), "c_acctbal")
    lists = I.table(spark, d, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").cast("string").alias("symbol"), F.expr(_CATEGORY).alias("category"))
    return c, lists


@query(f"WITH x AS (SELECT {_LABELS} AS c, c_acctbal > 0 AS o, coalesce(kn, false) AS kn, coalesce(co, false) AS co, coalesce(no, false) AS no FROM customer LEFT JOIN ({_FLAGS}) f ON f.k = c_custkey), g AS (SELECT count(*) AS n, count(*) FILTER (kn) AS known_found, count(*) FILTER (kn AND (c LIKE '%ultradian' OR c = 'harmonic')) AS known_detected, count(*) FILTER (kn AND c LIKE '%ultradian') AS known_independent, count(*) FILTER (kn AND c = 'harmonic') AS known_harmonic, count(*) FILTER (co) AS core_found, count(*) FILTER (co AND c = 'circadian_only') AS core_right, count(*) FILTER (no) AS none_found, count(*) FILTER (no AND c <> 'non_rhythmic') AS none_rhythmic, count(*) FILTER (c LIKE '%ultradian' OR c = 'harmonic') AS half_period, count(*) FILTER (o AND (c LIKE '%ultradian' OR c = 'harmonic')) AS overlap FROM x) SELECT *, {I.q6('known_detected / greatest(known_found, 1)', 'known_rate')}, {I.q6('core_right / greatest(core_found, 1)', 'core_rate')}, {I.q6('none_rhythmic / greatest(none_found, 1)', 'false_rate')}, {I.q6('half_period / greatest(n, 1)', 'half_period_rate')} FROM g")
def list_validation(spark, d):
    c, lists = _validated(spark, d)
    r = validation.list_report(c, lists, c.where("c_acctbal > 0").select("symbol"))
    rates = ("known_rate", "core_rate", "false_rate", "half_period_rate")
    return r.select(*[x for x in r.columns if x not in rates], *[I.r6(F.col(x), x) for x in rates])


_CONDITION = lambda name, label, right: f"SELECT '{name}' AS condition, count(*) FILTER (kn) AS known_found, count(*) FILTER (co) AS core_found, {I.q6(f'count(*) FILTER (kn AND ({label} LIKE {chr(39)}%ultradian{chr(39)} OR {label} = {chr(39)}harmonic{chr(39)})) / greatest(count(*) FILTER (kn), 1)', 'detected_rate')}, {I.q6(f'count(*) FILTER (kn AND {label} LIKE {chr(39)}%ultradian{chr(39)}) / greatest(count(*) FILTER (kn), 1)', 'independent_rate')}, {I.q6(f'count(*) FILTER (kn AND {label} = {chr(39)}harmonic{chr(39)}) / greatest(count(*) FILTER (kn), 1)', 'harmonic_rate')}, {I.q6(f'count(*) FILTER (co AND {label} = {chr(39)}{right}{chr(39)}) / greatest(count(*) FILTER (co), 1)', 'core_rate')} FROM x"


@query(f"WITH x AS (SELECT {_LABELS} AS w, CASE WHEN c_acctbal > 4500 THEN {_LABELS} ELSE 'non_rhythmic' END AS k, coalesce(kn, false) AS kn, coalesce(co, false) AS co FROM customer LEFT JOIN ({_FLAGS}) f ON f.k = c_custkey) {_CONDITION('wt', 'w', 'circadian_only')} UNION ALL {_CONDITION('ko', 'k', 'non_rhythmic')}")
def condition_validation(spark, d):
    c, lists = _validated(spark, d)
    ko = c.withColumn("classification", F.when(F.col("c_acctbal") > 4500, F.col("classification")).otherwise("non_rhythmic"))
    r = validation.condition_report(c, ko, lists)
    return r.select("condition", "known_found", "core_found", *[I.r6(F.col(x), x) for x in ("detected_rate", "independent_rate", "harmonic_rate", "core_rate")])


@query()
def labelled_benchmark(spark, d):
    """All methods on the given vectors, whose labels are the lists: scores by method."""
    v = I.vectors_with_label(spark, d)
    lists = v.select(F.col("series_id").alias("symbol"), F.when(F.col("label") < 4, "known_12h").when(F.col("label") < 7, "core_circadian").otherwise("housekeeping").alias("category"))
    return validation.summary(validation.benchmark({"vectors": v.select("series_id", "t", "y")}, lists))["by_dataset"]
