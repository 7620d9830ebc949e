"""Ranking and classification metrics of churn probabilities.

All take a frame with ``churned`` (0/1) and ``churn_probability``. Probabilities are
first counted per distinct value, then accumulated over the sorted values without ever
bringing all clients into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookpulse.functions.numbers import ratio
from bookpulse.functions.running import running_totals

FOLDS, SEED = 5, 42
#: Groups of clients that are numbered on their own; bounds the rows of one numbering.
BUCKETS = 4096


def stratified_folds(labels: DataFrame, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Add ``fold``: shuffled by a seeded hash, class counts per fold differ by at most 1.

    Clients are numbered within hash buckets, in one shuffle; the number of clients in the
    buckets before (a table of two classes times ``BUCKETS`` rows) is added. Reads
    ``labels`` twice: pass a written table.
    """
    mixed = F.xxhash64("client_id", F.lit(seed))
    bucket = F.pmod(mixed, F.lit(BUCKETS)).alias("_bucket")
    counts = labels.groupBy("churned", bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("churned").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "churned", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("churned", "_bucket").orderBy("_shuffle", "client_id")
    numbered = labels.select("*", mixed.alias("_shuffle"), bucket).withColumn("_n", F.row_number().over(inside))
    fold = ((F.col("_before") + F.col("_n") - 1) % folds).cast("int")
    return numbered.join(offsets, ["churned", "_bucket"]).select(*labels.columns, fold.alias("fold"))


def threshold_table(scored: DataFrame) -> DataFrame:
    """Per distinct probability: positives and negatives, there and so far in ascending order.

    Written once; ranks, precision and recall all follow from it.
    """
    per_value = scored.groupBy("churn_probability").agg(
        F.count_if(F.col("churned") == 1).alias("positives"),
        F.count_if(F.col("churned") == 0).alias("negatives"),
    )
    return running_totals(
        per_value, [], [F.col("churn_probability")],
        {"positives_so_far": F.col("positives"), "negatives_so_far": F.col("negatives")},
    )


def _ranked(thresholds: DataFrame) -> DataFrame:
    tied = F.col("positives") + F.col("negatives")
    so_far = F.col("positives_so_far") + F.col("negatives_so_far")
    return thresholds.withColumn("average_rank", so_far - (tied - 1) / F.lit(2.0))


def _recalled(thresholds: DataFrame) -> DataFrame:
    """Counts at or above each probability: all of them less those below."""
    positives, negatives = (thresholds.agg(F.sum(c)).scalar() for c in ("positives", "negatives"))
    found = positives - F.col("positives_so_far") + F.col("positives")
    wrong = negatives - F.col("negatives_so_far") + F.col("negatives")
    return thresholds.select(
        "churn_probability", "positives", found.alias("positives_so_far"), wrong.alias("negatives_so_far"),
        (found / (found + wrong)).alias("precision"), ratio(found, positives).alias("recall"),
    )


def rank_table(scored: DataFrame) -> DataFrame:
    """Average rank (from 1, ascending) shared by all clients with one probability."""
    return _ranked(threshold_table(scored)).select("churn_probability", "positives", "negatives", "average_rank")


def precision_recall_table(scored: DataFrame) -> DataFrame:
    """Precision and recall when everything at or above each probability is called churned."""
    return _recalled(threshold_table(scored))


def _area(thresholds: DataFrame) -> DataFrame:
    totals = _ranked(thresholds).agg(
        F.sum("positives").alias("p"), F.sum("negatives").alias("n"),
        # twice the rank is a whole number: exact whatever the order of rows
        F.sum((F.col("average_rank") * 2).cast("decimal(20,0)") * F.col("positives")).alias("twice"),
    )
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    area = (F.col("twice").cast("double") / 2 - p * (p + 1) / 2) / (p * n)
    return totals.select(F.when((p > 0) & (n > 0), area).alias("roc_auc"))


def _step_area(thresholds: DataFrame) -> DataFrame:
    return _recalled(thresholds).agg(
        (F.sum(F.col("positives") * F.col("precision")) / F.sum("positives")).alias("average_precision")
    )


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve from average ranks (one row)."""
    return _area(threshold_table(scored))


def average_precision(scored: DataFrame) -> DataFrame:
    """Step-wise area under precision over recall (one row)."""
    return _step_area(threshold_table(scored))


def ranking_metrics(scored: DataFrame) -> DataFrame:
    """Both areas in one row, from one threshold table."""
    thresholds = threshold_table(scored)
    return _area(thresholds).select("roc_auc", _step_area(thresholds).scalar().alias("average_precision"))


def _f1(precision: Column, recall: Column) -> Column:
    both = precision + recall
    return F.when(both > 0, 2 * precision * recall / both).otherwise(0.0)


def classification_report(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted means.

    One aggregate to four counts; the lines of the report are unpivoted from it. A class
    nobody was called scores 0.
    """
    truth, called = F.col("churned") == 1, F.col("churn_probability") > threshold
    counts = scored.agg(
        F.count_if(truth & called).alias("tp"), F.count_if(~truth & called).alias("fp"),
        F.count_if(truth & ~called).alias("fn"), F.count_if(~truth & ~called).alias("tn"),
    )
    share = lambda hit, of: F.when(of > 0, hit / of).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    classes = {"Activo": (tn, fn, fp), "Churned": (tp, fp, fn)}
    lines, measured = [], []
    for name, (hit, wrong, missed) in classes.items():
        precision, recall = share(hit, hit + wrong), share(hit, hit + missed)
        measured.append((precision, recall, _f1(precision, recall), hit + missed))
        lines.append((name, *measured[-1]))
    total = tp + fp + fn + tn
    accuracy = share(tp + tn, total)
    lines.append(("accuracy", accuracy, accuracy, accuracy, total))
    (a, b), supports = (m[:3] for m in measured), [m[3] for m in measured]
    lines.append(("macro avg", *[(x + y) / 2 for x, y in zip(a, b)], total))
    (a, b) = (m[:3] for m in measured)
    weighted = [share(x * supports[0] + y * supports[1], total) for x, y in zip(a, b)]
    lines.append(("weighted avg", *weighted, total))
    rows = [
        F.struct(
            F.lit(name).alias("line"), precision.alias("precision"), recall.alias("recall"),
            f1.alias("f1"), support.alias("support"),
        )
        for name, precision, recall, f1, support in lines
    ]
    return counts.select(F.inline(F.array(*rows)))
