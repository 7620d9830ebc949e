"""Golden rows: the product of date parts, time parts and zones."""

import re
from datetime import date, datetime, timedelta
from itertools import product

import pytest
from pyspark.sql import functions as F

from bookpulse.functions import times

DATES = {
    "2025-07-04": 4, "2025/07/04": 4, "2025.07.04": 4, "2025-7-4": 4, "07/04/2025": 4, "7/4/2025": 4, "07-04-2025": 4, "04-Jul-2025": 4,
    "4 July 2025": 4, "4th July 2025": 4, "04 JUL 2025": 4, "Jul 04 2025": 4, "July 4, 2025": 4, "Jul. 4 2025": 4, "jul-04-2025": 4,
    "Fri, 04 Jul 2025": 4, "Friday July 4, 2025": 4, "07.04.2025": 4, "25/07/2025": 25, "25.07.2025": 25, "07/25/2025": 25, "20250704": 4,
}
CLOCKS = {
    "": (0, 0, 0, 0), " 10:11": (10, 11, 0, 0), " 10:11:12": (10, 11, 12, 0), " 9:05": (9, 5, 0, 0), " 10:11:12.5": (10, 11, 12, 500000),
    " 10:11:12,123456789": (10, 11, 12, 123456), " 10:11 PM": (22, 11, 0, 0), " 12:00 am": (0, 0, 0, 0), " 12:30:01 PM": (12, 30, 1, 0),
}
ZONES = {"": 0, "Z": 0, " UTC": 0, "+00": 0, " +02:00": 2, "-0300": -3, " +05": 5}


def read(spark, texts, **options):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    at = times.read_time(F.col("t"), **options)
    return [r[0] for r in df.select(F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS")).collect()]


def test_every_combination(spark):
    cases = []
    for (d, day), (clock, (h, m, s, us)), (zone, hours) in product(DATES.items(), CLOCKS.items(), ZONES.items()):
        if not clock and zone:
            continue
        cases.append((d + clock + zone, datetime(2025, 7, day, h, m, s, us) - timedelta(hours=hours)))
    found = read(spark, [c for c, _ in cases])
    wrong = [(t, got, want) for (t, want), got in zip(cases, found) if got != want.strftime("%Y-%m-%d %H:%M:%S.%f")]
    assert not wrong, wrong[:10]
    assert len(cases) > 1000


@pytest.mark.parametrize(("text", "wanted"), [
    ("20250704 101112", "2025-07-04 10:11:12"), ("20250704T101112Z", "2025-07-04 10:11:12"), ("20250704101112", "2025-07-04 10:11:12"),
    ("  2025/07/04 10:11:12+00 ", "2025-07-04 10:11:12"), ("2025-07-04T10:11:12+0200", "2025-07-04 08:11:12"), ("Sept 4 2025", "2025-09-04 00:00:00"),
    ("May 4 2025", "2025-05-04 00:00:00"), ("29 Feb 2024", "2024-02-29 00:00:00"),
])
def test_single_forms(spark, text, wanted):
    assert read(spark, [text]) == [wanted + ".000000"]


def test_other_texts_are_undated(spark):
    texts = [
        None, "", "nan", "soon", "2025", "2025-07", "10:11:12", "13/13/2025", "2025-02-30", "30 Feb 2025", "07/04/25", "2025/07/04 25:00",
        "2025/07/04 10:61", "2025/07/04 13:00 PM", "04-Foo-2025", "Jul 2025", "Jul 32 2025", "2025/07/04 10", "1751623872", "2025070",
        "07/04/2025 10:11:12 +25:00", "x 2025/07/04", "2025/07/04 x", "\u0001\u0001", "Marchtober 4 2025", "0/4/2025", "4/0/2025", "July 4, 2025 at ten",
    ]
    assert read(spark, texts) == [None] * len(texts)


def test_day_first(spark):
    texts = ["04/07/2025", "25/07/2025", "07/25/2025", "13/13/2025", "2025-07-04"]
    month = ["2025-04-07", "2025-07-25", "2025-07-25", None, "2025-07-04"]
    day = ["2025-07-04", "2025-07-25", "2025-07-25", None, "2025-07-04"]
    assert [x and x[:10] for x in read(spark, texts)] == month
    assert [x and x[:10] for x in read(spark, texts, day_first=True)] == day
    df = spark.createDataFrame([(t,) for t in [*texts, None, "no date"]], "t string")
    assert tuple(times.date_order(df, "t").first()) == (1, 1, 1)
    assert not times.reads_day_first(df, "t")
    assert times.reads_day_first(df.where("t <> '07/25/2025'"), "t")
    assert not times.reads_day_first(df.where("t = '04/07/2025'"), "t")


def test_days_of_every_month(spark):
    days = [date(2024, 1, 1) + timedelta(days=3 * i) for i in range(122)]
    for form in ("%d %B %Y", "%b %d, %Y", "%m/%d/%Y", "%Y%m%d"):
        assert [x[:10] for x in read(spark, [d.strftime(form) for d in days])] == [str(d) for d in days]


def test_iso_rows_meet_no_pattern(spark):
    """ISO times are cast; the patterns are tried for other texts only."""
    df = spark.createDataFrame([("2025-07-04 10:11:12+00",)], "t string")
    plan = df.select(times.read_time(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"coalesce\(CASE WHEN RLIKE", plan) or "coalesce" in plan
