import random

import numpy as np
import pandas as pd
import pytest
from conftest import column
from pyspark.sql import functions as F

from bookpulse.functions.numbers import exact_sum, read_number
from bookpulse.functions.quantiles import bucket, exact_quantiles
from bookpulse.functions.running import row_numbers, running_totals
from bookpulse.functions.text import day_name, fill, grouped, plain

QUARTERS = [0.0, 0.25, 0.5, 0.75, 1.0]


def numbers(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")


@pytest.mark.parametrize(
    ("text", "value"),
    [("12.5", 12.5), (" 7 ", 7.0), ("-3", -3.0), ("1e3", 1000.0), ("0", 0.0), ("N/A", None), ("", None),
     ("NaN", None), ("nan", None), ("inf", None), ("-Infinity", None), ("1.5d", None), ("2f", None), (None, None)],
)
def test_read_number(spark, text, value):
    df = spark.createDataFrame([(text,)], "t string")
    assert column(df.select(read_number(F.col("t")).alias("n")), "n") == [value]


def test_exact_sum_does_not_depend_on_order(spark):
    rng = random.Random(5)
    values = [rng.choice([0.1, 1e9 + 0.7, -3.3, 12345.678901]) for _ in range(5000)]
    sums = set()
    for partitions in (1, 3, 7):
        rng.shuffle(values)
        df = numbers(spark, values).repartition(partitions)
        sums.add(df.agg(exact_sum(F.col("v")).cast("double").alias("s")).first()["s"])
    assert len(sums) == 1
    assert sums.pop() == pytest.approx(sum(sorted(values)), abs=1e-3)


def test_exact_sum_of_very_large_and_very_small_numbers(spark):
    values = [1e15, 1e-9, -1e15, 3e-7, 4e-7, 2.5, 7e17, -7e17]
    sums = {
        numbers(spark, v).repartition(n).agg(exact_sum(F.col("v")).alias("s")).first()["s"]
        for n in (1, 3, 8) for v in (values, values[::-1])
    }
    assert sums == {2.500000701}
    assert numbers(spark, [1e300, 2.0, None]).agg(exact_sum(F.col("v")).alias("s")).first()["s"] == 1e300
    assert numbers(spark, [-0.1] * 10).agg(exact_sum(F.col("v")).alias("s")).first()["s"] == -1.0


def test_exact_sum_does_not_overflow(spark):
    total = spark.range(11_000_000).agg(exact_sum(F.lit(9e11) + F.col("id") % 2 * 0.5).alias("s")).first()["s"]
    assert total == 11_000_000 * 9e11 + 2_750_000


def test_exact_sum_of_nothing_is_null(spark):
    assert numbers(spark, [None]).agg(exact_sum(F.col("v")).alias("s")).first()["s"] is None


@pytest.mark.parametrize("small", [100_000, 20, 1])
@pytest.mark.parametrize("shape", ["spread", "ties", "hot", "constant", "two", "one"])
def test_exact_quantiles_equal_numpy(spark, small, shape):
    rng = np.random.default_rng(11)
    values = {
        "spread": rng.lognormal(8, 3, 3000),
        "ties": rng.integers(0, 12, 2000).astype(float),
        "hot": np.concatenate([np.full(1500, 7.0), rng.normal(7, 1, 1500)]),
        "constant": np.full(300, 4.0),
        "two": np.array([1.0, 2.0] * 200 + [2.0] * 50),
        "one": np.array([3.5]),
    }[shape]
    wanted = [*QUARTERS, 0.95, 0.99]
    found = exact_quantiles(numbers(spark, values).repartition(5), {"v": wanted}, small)["v"]
    assert found == list(np.percentile(values, [100 * p for p in wanted]))


def test_quantiles_skip_nulls_and_report_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    assert exact_quantiles(df, {"a": [0.5], "b": [0.5]}) == {"a": [2.0], "b": None}


def defined_buckets(values):
    """Quarters by their definition: distinct edges, of which a value exceeds so many; the lowest counts as above one."""
    edges = np.unique(np.quantile(values, QUARTERS))
    if len(edges) == 1:
        return [2] * len(values)
    return np.maximum(np.searchsorted(edges, values, side="left"), 1).tolist()


@pytest.mark.parametrize("seed", range(8))
def test_buckets_follow_their_definition(spark, seed):
    rng = random.Random(seed)
    pool = [0.0] * rng.randint(0, 30) + [rng.choice([rng.random() * 100, rng.randint(0, 9)]) for _ in range(60)]
    df = numbers(spark, pool).withColumn("i", F.monotonically_increasing_id())
    edges = exact_quantiles(df, {"v": QUARTERS})["v"]
    got = column(df.withColumn("b", bucket(F.col("v"), edges, 4)).orderBy("i"), "b")
    assert got == defined_buckets(pool)


@pytest.mark.parametrize(
    ("values", "buckets"),
    [([5, 5, 5, 5], [2, 2, 2, 2]), ([9], [2]), ([0, 0, 0, 0, 0, 0, 0, 8], [1] * 8), ([1, 2], [1, 4])],
)
def test_bucket_edge_cases(spark, values, buckets):
    df = numbers(spark, values).coalesce(1)
    edges = exact_quantiles(df, {"v": QUARTERS})["v"]
    assert column(df.select(bucket(F.col("v"), edges, 4).alias("b")), "b") == buckets


def test_missing_value_is_bucket_two_and_descending_flips(spark):
    df = numbers(spark, [1, 2, 3, 4, None]).coalesce(1)
    edges = exact_quantiles(df, {"v": QUARTERS})["v"]
    assert column(df.select(bucket(F.col("v"), edges, 4).alias("b")), "b") == [1, 2, 3, 4, 2]
    assert column(df.select(bucket(F.col("v"), edges, 4, False).alias("b")), "b") == [4, 3, 2, 1, 3]


def test_running_totals_over_many_pieces(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 9)}", i, rng.randint(0, 5)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, i int, n int").repartition(6)
    got = running_totals(df, ["k"], [F.col("i")], {"total": F.col("n").cast("bigint")}).toPandas()
    want = pd.DataFrame(rows, columns=["k", "i", "n"]).sort_values("i")
    want["total"] = want.groupby("k")["n"].cumsum()
    assert dict(zip(got.i, got.total)) == dict(zip(want.i, want.total))


def test_running_totals_without_keys_and_row_numbers(spark):
    df = spark.range(500).repartition(5)
    total = running_totals(df, [], [F.col("id").desc()], {"s": F.col("id")}).agg(F.max("s")).first()[0]
    assert total == sum(range(500))
    numbered = row_numbers(df, [], [F.col("id")], "n")
    assert numbered.where(F.col("n") != F.col("id") + 1).count() == 0


@pytest.mark.parametrize("value", [0.5, 1.5, 2.5, 0.005, 1234.5, 1234567.891, 0.0, 99999.5])
def test_number_texts_equal_python(spark, value):
    row = numbers(spark, [value]).select(
        grouped(F.col("v")).alias("a"), plain(F.col("v")).alias("b"), plain(F.col("v"), 2).alias("c")
    ).first()
    assert tuple(row) == (f"{value:,.0f}", f"{value:.0f}", f"{value:.2f}")


def test_missing_number_text_and_fill_and_day_name(spark):
    row = spark.range(1).select(
        plain(F.lit(None).cast("double"), 2).alias("nan"),
        fill("a {x}: {{b}} {y}", {"x": F.lit(3), "y": "z"}).alias("text"),
        day_name(F.lit(6), "?").alias("sunday"), day_name(F.lit(7), "?").alias("none"),
    ).first()
    assert tuple(row) == ("nan", "a 3: {b} z", "Domingo", "?")
