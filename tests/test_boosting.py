"""Histogram boosting against a plain single-machine version."""

import random

import numpy as np
import pytest
from conftest import column
from pyspark import TaskContext
from pyspark.sql import functions as F

from bookpulse import fixed_values as fv
from bookpulse.operators import boosting, churn_model, metrics
from bookpulse.session import stage

NAMES = ("a", "b", "c")


def plain_boosting(keys, y, x, rounds, depth, rate, row_share, column_share, seed, bins):
    """Trees grown node by node over arrays; margins of all rows."""
    n, edges = len(y), []
    for column in x:
        ordered = np.sort(column)
        edges.append(np.unique([ordered[max(1, int(np.ceil(k * n / bins))) - 1] for k in range(1, bins)]))
    binned = [np.searchsorted(e, c) for e, c in zip(edges, x)]
    p = y.mean()
    margin = np.full(n, np.log(p / (1 - p)))

    def worth(g, h):
        return g * g / (h + 1)

    def grow(rows, everyone, g, h, level, used):
        best = (1e-6, None, None)
        if level < depth:
            for f in used:
                for b in range(bins):
                    left = binned[f][rows] <= b
                    gl, hl, gr, hr = g[rows][left].sum(), h[rows][left].sum(), g[rows][~left].sum(), h[rows][~left].sum()
                    if hl >= 1 and hr >= 1 and (gain := worth(gl, hl) + worth(gr, hr) - worth(gl + gr, hl + hr)) > best[0] + 1e-12:
                        best = (gain, f, b)
        if best[1] is None:
            margin[everyone] -= rate * g[rows].sum() / (h[rows].sum() + 1)
            return
        for side in (lambda r: r[binned[best[1]][r] <= best[2]], lambda r: r[binned[best[1]][r] > best[2]]):
            grow(side(rows), side(everyone), g, h, level + 1, used)

    for turn in range(rounds):
        number = seed * 1_000_003 + turn
        p = 1 / (1 + np.exp(-margin))
        grow(np.flatnonzero(boosting.drawn(keys, number, row_share)), np.arange(n), p - y, p * (1 - p), 0,
             boosting.columns_of(number, len(x), column_share).tolist())
    return margin


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    out = []
    for i in range(700):
        a, b, c = r.gauss(0, 1), r.choice([0.0, 1.0, 1.0, 5.0]), r.random()
        out.append((f"c{i}", int(a + (b == 1) * c + r.gauss(0, 0.7) > 0.6), i % 5, a, b, c))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    df = spark.createDataFrame(rows, "client_id string, churned int, fold int, a double, b double, c double")
    return stage(df.repartition(3), "boosted")


def fitted(table, rounds=30, **options):
    return boosting.fit(table, NAMES, "churned", "client_id", rounds, 3, 0.2, 0.8, 0.7, 5, bins=16, **options)


def keys_of(spark, rows):
    df = spark.createDataFrame([(x[0],) for x in rows], "client_id string")
    return {r[0]: r[1] for r in df.select("client_id", boosting.row_key(F.col("client_id"))).collect()}


def test_against_plain_boosting(spark, table, rows):
    model = fitted(table)[0]
    keys = keys_of(spark, rows)
    x = [np.array([r[3 + k] for r in rows]) for k in range(3)]
    want = plain_boosting(np.array([keys[r[0]] for r in rows]), np.array([r[1] for r in rows]), x, 30, 3, 0.2, 0.8, 0.7, 5, 16)
    assert np.abs(model.margins(x) - want).max() < 1e-6
    assert len(model.trees) == 30 and 1 <= model.depth <= 3
    scored = boosting.with_probability(model, table, "churn_probability")
    assert metrics.roc_auc(scored).first()[0] > 0.8


def test_models_do_not_depend_on_partitions(table, monkeypatch):
    first = boosting.node_table(fitted(table, 27)[0]).collect()
    # Three tasks, a job a level, a checkpoint after every third tree.
    monkeypatch.setattr(boosting, "CHECKPOINT", 3)
    parted = fitted(table.repartition(7).sortWithinPartitions("c"), 8, task_rows=250)[0]
    assert [r for r in first if r.tree < 8] == boosting.node_table(parted).collect() and len(first) > 27


def test_many_models_in_the_same_jobs(table):
    """Left-out folds together give the same models as one after another."""
    together = fitted(table, 6, fold="fold", left_out=(0, 3, -1))
    alone = [fitted(table, 6, fold="fold", left_out=(k,))[0] for k in (0, 3, -1)]
    only = fitted(stage(table.where("fold <> 3"), "boosted"), 6)[0]
    for a, b in zip(together, alone):
        assert boosting.node_table(a).collect() == boosting.node_table(b).collect()
    assert [t.cover.sum() for t in only.trees][0] == pytest.approx(together[1].trees[0].cover.sum(), rel=0.1)


def test_models_are_fitted_in_tasks_of_their_own(table, monkeypatch, tmp_path):
    """No task boosts the rows of two models."""
    here = boosting._boosted_here

    def noted(rows, models, *options):
        (tmp_path / f"{TaskContext.get().partitionId()}-{len(models)}").write_text("")
        here(rows, models, *options)

    monkeypatch.setattr(boosting, "_boosted_here", noted)
    assert all(len(m.trees) == 2 for m in fitted(table, 2, fold="fold", left_out=(0, 1, 2, 3, 4)))
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"{k}-1" for k in range(5)]


def test_saved_model(table, tmp_path):
    model = fitted(table, 5)[0]
    boosting.save(model, str(tmp_path / "m"))
    loaded = boosting.load(str(tmp_path / "m"))
    x = [np.array(column(table, c)) for c in NAMES]
    assert (loaded.margins(x) == model.margins(x)).all() and loaded.depth == model.depth
    assert loaded.importances().tolist() == model.importances().tolist()
    assert loaded.importances().sum() == pytest.approx(1)


def test_edges_of_fitting(spark, table):
    empty = fitted(table.where("false"), 3)[0]
    assert empty.trees == [] and boosting.with_probability(empty, table, "p").agg(F.min("p"), F.max("p")).first() == (0.5, 0.5)
    one_class = fitted(stage(table.where("churned = 0"), "boosted"), 3)[0]
    assert boosting.with_probability(one_class, table, "p").agg(F.max("p")).first()[0] < 0.01
    same = table.withColumns({"a": F.lit(1.0), "b": F.lit(2.0), "c": F.lit(0.0)})
    flat = fitted(stage(same, "boosted"), 3)[0]
    assert flat.depth == 0 and flat.importances().sum() == pytest.approx(1)
    few = fitted(stage(table.limit(2), "boosted"), 2)[0]
    assert few.depth == 0


def test_near_the_trees_of_spark(spark):
    """Held-out areas under the curve of both learners differ by less than a hundredth."""
    r = random.Random(8)
    rows = []
    for i in range(1500):
        x = [r.gauss(0, 1) for _ in fv.MODEL_FEATURES]
        rows.append((f"c{i:04d}", int(x[0] * 1.5 + x[1] * x[2] + abs(x[3]) + r.gauss(0, 0.7) > 1), *x))
    df = spark.createDataFrame(rows, "client_id string, churned int, " + ", ".join(f"{c} double" for c in fv.MODEL_FEATURES))
    df = stage(df.coalesce(2), "training")
    train, held = df.where("client_id < 'c1000'"), df.where("client_id >= 'c1000'")
    ours = boosting.with_probability(churn_model.fit(stage(train, "training"), 40), held, "churn_probability")
    from bookpulse.session import keep_checkpoints
    from pyspark.ml.functions import vector_to_array

    keep_checkpoints(spark)
    theirs = churn_model.unfitted_model(40).fit(train).transform(held).withColumn(
        "churn_probability", F.get(vector_to_array("probability"), F.lit(1)))
    a, b = (metrics.roc_auc(s).first()[0] for s in (ours, theirs))
    assert a > 0.85 and a > b - 0.01
