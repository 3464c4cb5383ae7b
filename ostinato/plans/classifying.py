"""Queries of whole classifiers, trained models and decompositions, and of how they hold under changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, decompose, detect, evidence, metrics, models, per_series, population, series
from . import inputs as I

Q: dict = {}
SQL: dict[str, str] = {}


def query(f):
    Q[f.__name__] = f
    return f


@query
def two_stage_classifier(spark, d):
    return classify.two_stage(I.spread(spark, d))


@query
def hard_gated_classifier(spark, d):
    return classify.batch(I.vectors(spark, d), version=1)


@query
def soft_gated_classifier(spark, d):
    return classify.batch(I.vectors(spark, d), version=2)


@query
def ensemble_classifier(spark, d):
    e = classify.ensemble(I.vectors(spark, d))
    return e.select("series_id", "analytic_label", "lrt_label", "classification", "confidence", "error")


@query
def fusion_classifier(spark, d):
    f = classify.fusion(I.vectors(spark, d))
    return f.select("series_id", "v2_classification", "p_bispectral", "classification", "confidence", "reason", "channels_agree", "has_significant_12h", "error")


def _labelled_features(spark, d):
    """Features of the given vectors, with their given labels."""
    m = evidence.models(per_series.spread(I.vectors_with_label(spark, d)))
    three = [24.0, 12.0, 8.0]
    m = per_series.apply(m.drop("error"), lambda t, y, _: {"p_24": detect.K.component_p(t, y, three, 0), "p_12": detect.K.component_p(t, y, three, 1)}, "p_24 double, p_12 double")
    m = models.features(m.withColumn("log_bf", evidence.log_bayes_factor()))
    return m.select("series_id", F.col("label").cast("string").alias("label"), *[f"x_{f}" for f in models.FEATURES])


@query
def gaussian_discriminant(spark, d):
    x = _labelled_features(spark, d)
    cols = [f"x_{f}" for f in models.FEATURES]
    return models.Discriminant.fit(x, "label", cols).predict(x, cols).select("series_id", "label", "gda_class", "gda_confidence", "probabilities")


@query
def calibrated_logistic(spark, d):
    x = _labelled_features(spark, d)
    cols = [f"x_{f}" for f in models.FEATURES[:7]]
    _, predict = models.calibrated(x, "label", cols)
    return predict(x).select("series_id", "label", "calibrated_class", "class_probabilities")


@query
def damped_decomposition(spark, d):
    return decompose.decompose(I.spread(spark, d)).drop("t", "y")


@query
def trained_decomposition(spark, d):
    return decompose.trained(I.spread(spark, d)).drop("t", "y")


@query
def damping_of_oscillators(spark, d):
    o = decompose.long_oscillators(decompose.decompose(I.spread(spark, d)))
    return population.damping_summary(o, ["oscillator"])


@query
def scenario_accuracy(spark, d):
    """Of the vectors of each given label the share for which decomposition and the first stage agree on whether there is a rhythm."""
    c = decompose.decompose(I.spread(spark, d)).select("series_id", "classification")
    s = detect.stage1(I.vectors_with_label(spark, d)).select("series_id", "label", "passed").join(c, "series_id")
    return metrics.recovery(s, ["label"], F.coalesce("passed", F.lit(False)) == (F.col("classification") != "non_rhythmic"))


@query
def downsampling_robustness(spark, d):
    """F1 of the first stage on every second and fourth point of the vectors, where all points tell the truth."""
    v = I.vectors(spark, d)
    found = lambda x, name: detect.stage1(x).select("series_id", F.coalesce("passed", F.lit(False)).alias(name))
    truth, out = found(v, "truth"), None
    for k in (1, 2, 4):
        x = found(series.downsample(v, k), "positive").join(truth, "series_id").withColumn("every", F.lit(k))
        out = x if out is None else out.unionByName(x)
    return metrics.binary(out, F.col("truth"), F.col("positive"), ["every"]).select("every", "tp", "fp", "tn", "fn", "sensitivity", "specificity", "f1")


@query
def noise_robustness(spark, d):
    """Share of the vectors that the first stage passes, by the spread of noise added to them (in spreads of the vector)."""
    v, out = I.spread(spark, d), None
    for sd in (0.0, 0.5, 1.0, 2.0):
        x = detect.stage1(series.noised(v, sd)).select(F.lit(sd).alias("noise"), "passed")
        out = x if out is None else out.unionByName(x)
    return metrics.recovery(out, ["noise"], F.coalesce("passed", F.lit(False)))


@query
def sensitivity_sweep(spark, d):
    """Labels of the two-stage classifier's confidence under other divisors: counts for each setting."""
    r = classify.two_stage(I.spread(spark, d)).where("stage1_class = 'has_12h'")
    grid = F.explode(F.lit([float(x) for x in metrics.sensitivity(4.0)])).alias("divisor")
    c = F.tanh(F.col("evidence_score") / F.col("divisor"))
    label = F.when(c >= 0.6, "independent_ultradian").when(c >= 0.3, "likely_independent_ultradian").when(c <= -0.3, "harmonic").otherwise("ambiguous")
    return r.select("series_id", "evidence_score", grid).withColumn("label", label).groupBy("divisor", "label").agg(F.count("*").alias("n"))
