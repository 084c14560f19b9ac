"""Purged chronological modelling with Spark ML.

Fits and predictions are distributed; the driver only walks over a few refit
dates.  Split points come from the distinct sample dates, which are bounded by
the calendar.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import quantiles

FOLD_STARTS = (0.58, 0.70, 0.82)


def sample_dates(df: DataFrame, no: str = "session_no") -> DataFrame:
    """Distinct sample sessions with their position from 0 and their number."""
    d = df.select(no).distinct()
    n = d.agg(F.count("*")).scalar()
    return d.withColumn("position", F.row_number().over(Window.orderBy(no)) - 1).withColumn("dates", n)


def fold_of(starts: tuple[float, ...] = FOLD_STARTS) -> Column:
    """Fold number by the share of dates before: -1 trains only, then 0, 1, 2 …"""
    hits = [F.when(F.col("position") >= F.floor(F.col("dates") * s), 1).otherwise(0) for s in starts]
    return reduce(lambda a, b: a + b, hits) - 1


def purged_folds(df: DataFrame, horizon: int, starts: tuple[float, ...] = FOLD_STARTS, no: str = "session_no") -> DataFrame:
    """Add ``fold`` and ``crosses``: the label ends in or after the next fold's first session."""
    d = sample_dates(df, no).withColumn("fold", fold_of(starts))
    first = d.groupBy("fold").agg(F.min(no).alias("_first")).select((F.col("fold") - 1).alias("fold"), F.col("_first").alias("next_start"))
    d = d.join(F.broadcast(first), "fold", "left")
    out = df.join(F.broadcast(d.select(no, "fold", "next_start")), no)
    return out.withColumn("crosses", F.coalesce(F.col(no) >= F.col("next_start") - horizon, F.lit(False)))


def training_before(df: DataFrame, boundary: Column | int, label_end: str = "label_end_no", target: str = "target") -> DataFrame:
    """Rows whose label had ended before the boundary session, by its actual exit."""
    return df.where(F.col(target).isNotNull() & (F.col(label_end) < boundary))


def family_rows(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Rows with at least half of a family's features."""
    known = reduce(lambda a, b: a + b, [F.col(n).isNotNull().cast("int") for n in names])
    return df.where(known >= max(1, len(names) // 2))


def date_weights(df: DataFrame, day: str) -> DataFrame:
    """Every date weighs the same, however many rows it has."""
    n = df.groupBy(day).agg(F.count("*").alias("_n"))
    rows, dates = n.agg(F.sum("_n")).scalar(), n.agg(F.count("*")).scalar()
    return df.join(F.broadcast(n), day).withColumn("weight", rows / (dates * F.col("_n"))).drop("_n")


def period_of(no: str, dates: DataFrame, cuts: tuple[float, float] = (0.6, 0.8)) -> DataFrame:
    """Each date as train, selection or holdout."""
    a, b = (F.floor(F.col("dates") * c) for c in cuts)
    return dates.select(no, F.when(F.col("position") < a, "train").when(F.col("position") < b, "selection").otherwise("holdout").alias("period"))


def _stages(features: tuple[str, ...]) -> tuple[list[Column], list]:
    """Missing-value flags, median imputation and one feature vector."""
    flags = [F.col(f).isNull().cast("double").alias(f"{f}_missing") for f in features]
    impute = Imputer(inputCols=list(features), outputCols=[f"{f}_filled" for f in features], strategy="median")
    vector = VectorAssembler(inputCols=[*[f"{f}_filled" for f in features], *[f"{f}_missing" for f in features]], outputCol="features")
    return flags, [impute, vector]


def with_flags(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    return df.select("*", *_stages(features)[0])


def fit_regressor(df: DataFrame, features: tuple[str, ...], target: str, weight: str | None = None, rounds: int = 100) -> PipelineModel:
    gbt = GBTRegressor(featuresCol="features", labelCol=target, predictionCol="prediction", maxDepth=3, maxIter=rounds, stepSize=0.05, minInstancesPerNode=40, seed=42)
    if weight:
        gbt = gbt.setWeightCol(weight)
    return Pipeline(stages=[*_stages(features)[1], gbt]).fit(with_flags(df, features))


def fit_classifier(df: DataFrame, features: tuple[str, ...], label: str, rounds: int = 100) -> PipelineModel:
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxDepth=3, maxIter=rounds, stepSize=0.05, minInstancesPerNode=40, seed=42)
    return Pipeline(stages=[*_stages(features)[1], gbt]).fit(with_flags(df, features))


def raw_probability(model: PipelineModel, df: DataFrame, features: tuple[str, ...], out: str = "raw") -> DataFrame:
    return model.transform(with_flags(df, features)).withColumn(out, vector_to_array("probability")[1]).select(*df.columns, out)


def predict(model: PipelineModel, df: DataFrame, features: tuple[str, ...], out: str) -> DataFrame:
    return model.transform(with_flags(df, features)).select(*df.columns, F.col("prediction").alias(out))


def calibrate(scored: DataFrame, label: str, raw: str = "raw") -> PipelineModel:
    """Logistic curve over the raw score, fitted on a period of its own."""
    return Pipeline(stages=[VectorAssembler(inputCols=[raw], outputCol="_cal"), LogisticRegression(featuresCol="_cal", labelCol=label, probabilityCol="_cal_p", predictionCol="_cal_y", rawPredictionCol="_cal_r")]).fit(scored)


def calibrated(model: PipelineModel, df: DataFrame, out: str = "probability_up") -> DataFrame:
    return model.transform(df).withColumn(out, vector_to_array("_cal_p")[1]).select(*df.columns, out)


def downside_by_score(train: DataFrame, score: str, outcome: str, buckets: int = 10, level: float = 0.1) -> tuple[DataFrame, list[float]]:
    """Empirical low quantile of the outcome per score bucket of the training rows."""
    cuts = quantiles(train.where(F.col(score).isNotNull()).withColumn("_all", F.lit(1)), ["_all"], score, {f"q{i}": i / buckets for i in range(1, buckets)}).first()
    edges = [cuts[f"q{i}"] for i in range(1, buckets)] if cuts else []
    b = train.withColumn("bucket", score_bucket(F.col(score), edges))
    return quantiles(b, ["bucket"], outcome, {"downside_p10": level}).select("bucket", "downside_p10"), edges


def score_bucket(score: Column, edges: list[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= score))


def walk_forward(df: DataFrame, features: tuple[str, ...], boundaries: list[int], excess: str, outcome: str, rounds: int = 20, no: str = "session_no") -> DataFrame:
    """Predictions of each span between refits from rows whose labels ended before it."""
    parts = []
    ends = [*boundaries[1:], None]
    for start, end in zip(boundaries, ends):
        train = date_weights(training_before(df, start, target=excess), no)
        span = df.where((F.col(no) >= start) & (F.lit(True) if end is None else F.col(no) < end))
        m1, m2 = fit_regressor(train, features, excess, "weight", rounds), fit_regressor(train, features, outcome, "weight", rounds)
        low, edges = downside_by_score(predict(m2, train, features, "expected_return"), "expected_return", outcome)
        p = predict(m2, predict(m1, span, features, "expected_excess"), features, "expected_return")
        p = p.withColumn("bucket", score_bucket(F.col("expected_return"), edges))
        # Ten buckets at most.
        parts.append(p.join(F.broadcast(low), "bucket", "left").drop("bucket").withColumn("refit_no", F.lit(start)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def standardized(df: DataFrame, features: tuple[str, ...], by: str, order: str) -> DataFrame:
    """Each feature against the entity's own past: mean and deviation of the earlier rows only.

    One row per session bounds the window.
    """
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    z = {f"z_{f}": (F.col(f) - F.avg(f).over(w)) / F.when(F.stddev_samp(f).over(w) > 0, F.stddev_samp(f).over(w)) for f in features}
    return df.withColumns(z)
