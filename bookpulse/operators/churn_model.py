"""Churn model: boosted trees over client features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookpulse import schemas
from bookpulse.fixed_values import CHURN_WINDOW_DAYS, MODEL_FEATURES
from bookpulse.functions.text import plain
from bookpulse.operators import boosting, metrics
from bookpulse.operators import labels as churn
from bookpulse.operators.boosting import BoostedTrees
from bookpulse.session import stage

LEARNER = "gradient-boosted trees"
ROUNDS, DEPTH, RATE, ROW_SHARE, COLUMN_SHARE, SEED = 300, 4, 0.05, 0.8, 0.8, 42


def fill_features(features: DataFrame) -> DataFrame:
    """Missing model inputs become 0."""
    return features.fillna(0, list(MODEL_FEATURES))


def training_set(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled clients with filled model inputs."""
    return fill_features(features.join(labels, "client_id"))


def unfitted_model(rounds: int = ROUNDS, seed: int = SEED) -> Pipeline:
    """Spark ML's trees over the same inputs, for comparison: feature vector, then boosted trees.

    Residuals are checkpointed every 25 rounds, often enough to keep their lineage short.
    Trees of depth 4 are passed down anew per row: node ids are not worth a cache.
    """
    trees = GBTClassifier(
        featuresCol="inputs", labelCol="churned", maxIter=rounds, maxDepth=DEPTH, stepSize=RATE,
        subsamplingRate=ROW_SHARE, featureSubsetStrategy=str(COLUMN_SHARE), seed=seed,
        checkpointInterval=25, cacheNodeIds=False,
    )
    return Pipeline(stages=[VectorAssembler(inputCols=list(MODEL_FEATURES), outputCol="inputs"), trees])


def fit_all(
    training: DataFrame, rounds: int = ROUNDS, seed: int = SEED, left_out: Sequence[int] = (-1,)
) -> list[BoostedTrees]:
    """A model per entry of ``left_out``, fitted to the clients of all other folds (-1: to all)."""
    return boosting.fit(
        training, MODEL_FEATURES, "churned", "client_id", rounds, DEPTH, RATE, ROW_SHARE, COLUMN_SHARE, seed,
        "fold" if any(k >= 0 for k in left_out) else None, left_out,
    )


def fit(training: DataFrame, rounds: int = ROUNDS, seed: int = SEED) -> BoostedTrees:
    """Fit on all labelled clients. Pass a written table: it is read several times."""
    return fit_all(training, rounds, seed)[0]


def _with_probability(model: BoostedTrees, df: DataFrame) -> DataFrame:
    return boosting.with_probability(model, df, "churn_probability")


def cross_validated(
    training: DataFrame, rounds: int = ROUNDS, folds: int = metrics.FOLDS, seed: int = SEED
) -> DataFrame:
    """Out-of-fold probabilities: every labelled client scored by a model that never saw it.

    The folds are fitted in the same jobs.
    """
    folded = stage(metrics.stratified_folds(training, folds, seed), "folds")
    models = fit_all(folded, rounds, seed, range(folds))
    held_out = [_with_probability(m, folded.where(F.col("fold") == k)) for k, m in enumerate(models)]
    return reduce(DataFrame.unionByName, held_out).select(
        "client_id", "churned", "fold", "churn_probability"
    )


def importances(model: BoostedTrees) -> DataFrame:
    """Mean gain of each input's splits as a share, highest first. One row per model input, ten in all."""
    return (
        SparkSession.active()
        .createDataFrame(
            [(name, float(weight)) for name, weight in zip(model.inputs, model.importances())],
            "feature string, importance double",
        )
        .orderBy(F.desc("importance"), "feature")
    )


def with_risk(scored: DataFrame) -> DataFrame:
    """Score table from a frame that holds client columns and ``churn_probability``."""
    p = F.col("churn_probability")
    return scored.withColumns(
        {"churn_score": churn.churn_score(p), "risk_label": churn.risk_label(p)}
    ).select(schemas.CHURN_SCORES.names)


def score_clients(model: BoostedTrees, features: DataFrame) -> DataFrame:
    """Churn score of every client, labelled or not."""
    return with_risk(_with_probability(model, fill_features(features)))


def top_risk(scores: DataFrame, rows: int = 10) -> DataFrame:
    """Clients most likely to leave."""
    return scores.orderBy(F.desc("churn_probability"), "client_id").limit(rows)


def churn_report(
    features: DataFrame, labels: DataFrame, validated: DataFrame, model: BoostedTrees | None, scores: DataFrame,
    reference: Column | None = None, window_days: int = CHURN_WINDOW_DAYS,
) -> DataFrame:
    """Model report as ``(section, key, value)`` rows.

    The head names the learner with its rounds, and importances are listed, if there is a
    ``model``; the reference date is in epoch seconds.
    """

    def wide(section: str, df: DataFrame) -> DataFrame:
        names = df.columns
        return df.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot(
            [], names, "key", "value"
        ).select(F.lit(section).alias("section"), "key", "value")

    report = metrics.classification_report(validated)
    lines = report.unpivot(
        ["line"],
        [F.col("precision"), F.col("recall"), F.col("f1"), F.col("support").cast("double").alias("support")],
        "measure", "value",
    ).select(F.lit("classification").alias("section"), F.concat_ws(" / ", "line", "measure").alias("key"), "value")
    parts = [
        wide("dataset", features.agg(F.count(F.lit(1)).alias("clients"))),
        wide("dataset", churn.label_summary(labels)),
        wide("metrics", metrics.ranking_metrics(validated)),
        lines,
        churn.risk_counts(scores).select(
            F.lit("risk").alias("section"), F.col("risk_label").alias("key"),
            F.col("clients").cast("double").alias("value"),
        ),
    ]
    head = [(f"learner: {LEARNER}", F.lit(float(len(model.trees))))] if model is not None else []
    if reference is not None:
        head.append(("reference_date", F.unix_micros(reference) / F.lit(1e6)))
    head.append(("window_days", F.lit(float(window_days))))
    parts.insert(0, SparkSession.active().range(1).select(F.inline(F.array(*[
        F.struct(F.lit("head").alias("section"), F.lit(key).alias("key"), value.alias("value")) for key, value in head
    ]))))
    if model is not None:
        parts.append(importances(model).select(
            F.lit("importance").alias("section"), F.col("feature").alias("key"),
            F.col("importance").alias("value"),
        ))
    return reduce(DataFrame.unionByName, parts)


def report_text(report: DataFrame) -> DataFrame:
    """The report with values formatted to three digits, the reference date as a date."""
    date = F.date_format(F.timestamp_micros((F.col("value") * 1_000_000).cast("bigint")), "yyyy-MM-dd")
    return report.withColumn(
        "text", F.when(F.col("key") == "reference_date", date).otherwise(plain(F.col("value"), 3))
    )
