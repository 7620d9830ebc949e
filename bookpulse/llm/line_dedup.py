"""Line dedup by site-relative frequency: lines on too many of a host's pages are boilerplate.

A line counts once per page, with blanks at its ends cut off; empty lines are neither
counted nor dropped. A line is boilerplate of a host if it stands on more than ``ratio`` of
the host's pages, copies included, and in at least ``least`` different texts: what only
stands in copies of one page is that page's own text, and left to deduplication.

Rows: a null text stays null and counts as a page; a text of boilerplate only becomes empty
and its row stays; rows without a host keep all lines; repeated rows are pages of their own;
a line on exactly ``ratio`` of the pages stays; very long texts are read whole, as one row;
an empty table gives no rows. Columns named like the two counts are replaced, others kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse.llm.common import free_name
from bookpulse.session import stage

#: The ratio decides on hosts of any size; a line of one text only is not repeated.
RATIO, LEAST = 0.1, 2


def line_hashes(text: Column) -> Column:
    """A 64-bit hash per line, blanks at the ends cut off; null for an empty line."""
    def hashed(line: Column) -> Column:
        bare = F.trim(line, F.lit(" \t\r"))
        return F.when(bare != "", F.xxhash64(bare))

    return F.transform(F.split(text, "\n"), hashed)


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """host and bad (hashes of its boilerplate lines), for hosts that have any.

    Different pages move as hash lists, once, with their number of copies; lines are counted with map-side combining, so neither a
    hot host nor a hot line moves more than a row per task. A list of boilerplate has at
    most (mean lines per page) / ratio entries.
    """
    text = F.col("text")
    pages = stage(
        docs.select(F.col(f"`{host}`").alias("host"), F.col("`text`").alias("text")).where(F.col("host").isNotNull())
        .groupBy("host", F.xxhash64(text).alias("page"), F.length(text).alias("length"))
        .agg(F.any_value(F.array_distinct(line_hashes(text))).alias("lines"), F.count("*").alias("copies")),
        "pages",
    )
    totals = pages.groupBy("host").agg(F.sum("copies").alias("pages"))
    counts = (
        pages.select("host", "copies", F.explode("lines").alias("line")).where(F.col("line").isNotNull())
        .groupBy("host", "line").agg(F.sum("copies").alias("on"), F.count("*").alias("texts")).where(F.col("texts") >= least)
    )
    often = counts.join(totals, "host").where(F.col("on") > F.col("pages") * ratio)
    return often.groupBy("host").agg(F.collect_list("line").alias("bad"))


def dedup_lines(docs: DataFrame, host: str = "source", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """``docs`` without boilerplate lines, and n_lines and n_dropped (lines before, lines dropped).

    The lists of boilerplate are written first, so Spark knows their size: it broadcasts
    them if small and else splits the hot hosts of a sort-merge join.
    """
    counted = ("n_lines", "n_dropped")
    docs = docs.drop(*counted)
    site, found = free_name(docs, "site"), free_name(docs, "found")
    lists = stage(boilerplate(docs, host, ratio, least), "boilerplate").select(F.struct("host", "bad").alias(site))
    text = F.col("`text`")
    lines, hashes = F.split(text, "\n"), line_hashes(text)
    none = F.array().cast("array<bigint>")
    joined = docs.join(lists, F.col(f"`{host}`") == F.col(f"{site}.host"), "left").withColumn(
        found, F.coalesce(F.array_intersect(hashes, F.col(f"{site}.bad")), none)
    )
    kept = F.transform(
        F.filter(
            F.arrays_zip(lines.alias("line"), hashes.alias("hash")),
            lambda x: ~F.coalesce(F.array_contains(found, x["hash"]), F.lit(False)),
        ),
        lambda x: x["line"],
    )
    some, total = F.size(found) > 0, F.when(text.isNull(), 0).otherwise(F.size(lines))
    return joined.select(
        *[F.when(some, F.array_join(kept, "\n")).otherwise(text).alias(c) if c == "text" else F.col(f"`{c}`")
          for c in docs.columns],
        total.cast("bigint").alias("n_lines"),
        F.when(some, total - F.size(kept)).otherwise(0).cast("bigint").alias("n_dropped"),
    )
