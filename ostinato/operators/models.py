"""Trained classifiers over evidence: Gaussian discriminants and a calibrated logistic regression."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from . import evidence

FEATURES = ("log_bf", "amp_ratio", "rel_dev", "rss_gain", "log_p24", "log_p12", "phase_gap", "bicoherence", "sd_log_bf")
CLASSES = ("independent_ultradian", "harmonic", "circadian_only", "non_rhythmic")


def features(df: DataFrame) -> DataFrame:
    """Adds the nine features, finite, 0 where their source is missing: from the analytic columns, and bicoherence and sd_log_bf if there."""
    have = set(df.columns)
    src = {
        "log_bf": F.col("log_bf"),
        "amp_ratio": evidence.amplitude_ratio(),
        "rel_dev": evidence.period_deviation(),
        "rss_gain": F.when(F.col("rss0") > 0, (F.col("rss0") - F.col("rss_free")) / F.col("rss0")),
        "log_p24": -F.log10(F.greatest("p_24", F.lit(1e-20))),
        "log_p12": -F.log10(F.greatest("p_12", F.lit(1e-20))),
        "phase_gap": F.abs(S.angle_between(F.col("phi_12"), 2 * F.col("phi_24"))),
        "bicoherence": F.col("bicoherence") if "bicoherence" in have else F.lit(0.0),
        "sd_log_bf": F.col("sd_log_bf") if "sd_log_bf" in have else F.lit(0.0),
    }
    finite = lambda c: F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e300), c).otherwise(0.0)
    return df.withColumns({f"x_{k}": finite(c.cast("double")) for k, c in src.items()})


@dataclass
class Discriminant:
    """Means, inverse covariances, log determinants and log priors of the classes, in order."""

    classes: list[str]
    mean: np.ndarray
    inverse: np.ndarray
    logdet: np.ndarray
    logprior: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, label: str, cols: list[str], ridge: float = 0.01) -> Discriminant:
        """From one aggregation: counts, means and covariances of each class (a row for each class reaches the driver). A class of one
        row takes the covariance of all; classes without rows don't occur."""
        pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
        stats = [F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]]
        rows = df.groupBy(label).agg(*stats).orderBy(label).collect()
        whole = df.agg(*stats).first()

        def cov(r) -> np.ndarray:
            r = r if r["n"] > 1 else whole
            m = np.zeros((len(cols), len(cols)))
            for i, j in pairs:
                m[i, j] = m[j, i] = r[f"c{i}_{j}"] or 0.0
            return m + ridge * np.eye(len(cols))

        covs = [cov(r) for r in rows]
        total = sum(r["n"] for r in rows)
        return cls([r[label] for r in rows], np.array([[r[f"m{i}"] for i in range(len(cols))] for r in rows]), np.array([np.linalg.inv(c) for c in covs]), np.array([np.linalg.slogdet(c)[1] for c in covs]), np.array([math.log(r["n"] / total) for r in rows]))

    def posterior(self, cols: list[Column]) -> Column:
        """An array of the classes' probabilities, as an expression: quadratic forms and a stable softmax."""
        add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
        dot = lambda u, v: add(F.zip_with(u, v, lambda x, y: x * y))

        def score(m: np.ndarray, a: np.ndarray, d: float, p: float) -> Column:
            x = F.array(*[c - float(v) for c, v in zip(cols, m, strict=True)])
            rows = F.transform(F.lit([[float(v) for v in row] for row in a]), lambda row: dot(row, x))
            return float(p) - 0.5 * float(d) - 0.5 * dot(x, rows)

        scores = [score(*parts) for parts in zip(self.mean, self.inverse, self.logdet, self.logprior, strict=True)]
        s = F.array(*scores)
        e = F.transform(s, lambda v: F.exp(v - F.array_max(s)))
        return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x))

    def predict(self, df: DataFrame, cols: list[str]) -> DataFrame:
        """Adds probabilities, gda_class and gda_confidence; the first of equal classes."""
        df = df.withColumn("probabilities", self.posterior([F.col(c) for c in cols]))
        names = F.lit(self.classes)
        at = F.array_position("probabilities", F.array_max("probabilities")).cast("int")
        return df.withColumn("gda_class", F.element_at(names, at)).withColumn("gda_confidence", F.array_max("probabilities"))


def truth_label(scenario: Column, independent: Column, harmonic: Column) -> Column:
    """The class that a simulated series belongs to."""
    return F.when(scenario.isin("pure_noise", "trend_noise"), "non_rhythmic").when(scenario == "pure_circadian", "circadian_only").when(harmonic & ~independent, "harmonic").when(independent, "independent_ultradian").otherwise("non_rhythmic")


def calibrated(train: DataFrame, label: str, cols: list[str], folds: int = 5, weight: str | None = None):
    """A fitted pipeline of standardised features and a multinomial logistic regression, its penalty chosen by cross-validation; and a
    function that adds calibrated_class and class_probabilities to a table."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="skip").fit(train)
    lr = LogisticRegression(featuresCol="_x", labelCol="_y", family="multinomial", predictionCol="_p", probabilityCol="_probs", rawPredictionCol="_raw", **({"weightCol": weight} if weight else {}))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_x", withMean=True), lr])
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.01, 0.1, 1.0]).build()
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(labelCol="_y", predictionCol="_p", metricName="f1"), numFolds=folds, seed=42)
    held = index.transform(train.select(label, *cols, *([weight] if weight else []))).persist(StorageLevel.MEMORY_AND_DISK)  # some twenty fits read it
    model = cv.fit(held).bestModel
    held.unpersist()

    def predict(df: DataFrame) -> DataFrame:
        out = IndexToString(inputCol="_p", outputCol="calibrated_class", labels=index.labels).transform(model.transform(df))
        return out.withColumn("class_probabilities", vector_to_array("_probs")).drop("_v", "_x", "_raw", "_probs", "_p")

    return model, predict
