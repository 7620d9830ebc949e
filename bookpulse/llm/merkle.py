"""Merkle manifest of a dataset: a root, a root per source, and a proof per document.

Documents are ranked within their source; the rank's digits (base ``WIDTH``) name the runs of a
document's way up. Blocks of ``WIDTH ** DIGITS`` neighbours are dealt out once by (source, block);
inside that partitioning one digit column after the other is grouped away, each time nesting the
children in their parent's struct, so a block ends as one row of bounded size. Block roots are
the nodes of the next tree above, rolled up alike, until one block holds all of a source; the
sources' roots make the last tree. Proofs come from the nested row alone, by ``transform`` and
``explode``: no document meets another row. Only a block, as one row, is given the way from its
root upwards, by a join of block rows that Spark splits or broadcasts by size.

Order: sources ascend by their bytes, null first; documents of a source ascend by doc_id, null
first, rows of one doc_id by their leaves. Rows: a null column counts as ``-``; an empty text is
no null; repeated rows are leaves of their own; a null doc_id is never tampered with; very long
texts are hashed whole and never moved; an empty table has no root and no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookpulse.llm.common import own_columns
from bookpulse.llm.quality_rules import let
from bookpulse.session import stage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node; rank digits that are grouped away within one block.
WIDTH, DIGITS = 16, 2
BLOCK = WIDTH ** DIGITS
_STEPS = "array<struct<before:string,after:string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of concatenated strings."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Each field as its UTF-8 byte count, a colon and its value, or ``-`` for null."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(*map(part, fields))


def leaves(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """key (source, so that null comes first and equals itself), doc_id, hash, other (tampered leaf or null)."""
    docs = own_columns(docs, *FIELDS)
    fields = [F.col(c) for c in FIELDS]
    other = F.lit(None).cast("string") if tampered_text is None else F.when(
        tampered_text.isNotNull(), leaf_digest([*fields[:-1], tampered_text]))
    return docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0")).alias("key"),
        F.col("doc_id").cast("bigint").alias("doc_id"), leaf_digest(fields).alias("hash"), other.alias("other"),
    )


def lower_cased(every: int = 5) -> Column:
    """Tampering: A-Z in lower case, where ``every`` divides the CRC-32 of the decimal doc_id."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return F.when(chosen, F.translate("text", _UPPER, _LOWER))


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add rank (from 0, within the key) and n (rows of the key).

    Rows are range-sorted over the cluster and written, ties dealt out as well; only one
    narrow row per key and sorted piece is added up, so a hot source costs nothing extra.
    """
    placed = stage(
        rows.orderBy("key", *order).withColumn("at", F.monotonically_increasing_id()), "ranked"
    ).withColumn("piece", F.shiftright("at", 33))
    of_key = Window.partitionBy("key")  # as many rows as sorted pieces hold the key
    before = of_key.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        placed.groupBy("key", "piece").agg(F.count("*").alias("c"), F.min("at").alias("first"))
        .select("key", "piece", "first", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"),
                F.sum("c").over(of_key).alias("n"))
    )
    rank = F.col("at") - F.col("first") + F.col("before")
    return placed.join(pieces, ["key", "piece"]).withColumn("rank", rank).drop("at", "piece", "first", "before")


def rolled(nodes: DataFrame, *payload: str) -> DataFrame:
    """key, n, block, hash and kids (nested structs) of every block of nodes (key, n, rank, hash, payload).

    One shuffle by (key, block); each ``groupBy`` then finds its rows together. A level of a
    single node is passed on as it is.
    """
    digits = [f"d{k}" for k in range(DIGITS)]
    rows = nodes.select(
        "key", "n", F.floor(F.col("rank") / BLOCK).alias("block"),
        *[(F.floor(F.col("rank") / WIDTH ** k) % WIDTH).cast("int").alias(d) for k, d in enumerate(digits)],
        F.struct("hash", "rank", *payload).alias("node"),
    ).repartition("key", "block")
    for k, digit in enumerate(digits):
        above = ["key", "n", "block", *digits[k + 1:]]
        rows = rows.groupBy(*above).agg(
            F.transform(F.sort_array(F.collect_list(F.struct(digit, "node"))), lambda x: x["node"]).alias("kids")
        )
        joined = F.sha2(F.array_join(F.transform("kids", lambda x: x["hash"]), ""), 256)
        own = F.when(F.col("n") > WIDTH ** k, joined).otherwise(F.col("kids")[0]["hash"])
        rows = rows.select(*above, F.struct(own.alias("hash"), "kids").alias("node"))
    return rows.select("key", "n", "block", "node.hash", "node.kids")


def _ways(kids: Column, level: int, n: Column, above: Column) -> Column:
    """Array of (node, steps) of all leaves below: what stands before and after a node, level by level."""
    none = F.array().cast(_STEPS)

    def of(hashes: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            step = F.struct(
                F.array_join(F.slice(hashes, 1, i), "").alias("before"),
                F.array_join(F.slice(hashes, i + 2, WIDTH), "").alias("after"),
            )
            steps = F.concat(F.when(n > WIDTH ** level, F.array(step)).otherwise(none), above)
            return _ways(x["kids"], level - 1, n, steps) if level else F.array(F.struct(x.alias("node"), steps.alias("steps")))

        return F.flatten(F.transform(kids, one))

    return let(F.transform(kids, lambda x: x["hash"]), of)


def climbed(blocks: DataFrame, paths: DataFrame, body=lambda x: x) -> DataFrame:
    """One row per leaf of ``blocks``, with the fields of ``body`` of its (node, steps) and paths' other columns."""
    others = [c for c in paths.columns if c not in ("key", "block", "above")]
    rows = blocks.select("key", "block", "n", "kids").join(paths, ["key", "block"])
    each = F.transform(_ways(F.col("kids"), DIGITS - 1, F.col("n"), F.col("above")), body)
    return rows.select("key", *others, F.explode(each).alias("x")).select("key", *others, "x.*")


def forest(nodes: DataFrame, *payload: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trees of nodes (key, n, rank, hash, payload): written blocks, their paths (key, block, above), roots (key, root).

    Every turn has a 256th of the rows of the one before; the deepest source decides how many there are.
    """
    blocks = stage(rolled(nodes, *payload), "blocks")
    most = blocks.agg(F.max("n")).first()[0] or 0
    if most <= BLOCK:
        paths = blocks.select("key", "block", F.array().cast(_STEPS).alias("above"))
        return blocks, paths, blocks.select("key", F.col("hash").alias("root"))
    tops = blocks.select("key", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("rank"), "hash")
    upper, ways, roots = forest(tops)
    found = climbed(upper, ways, lambda x: F.struct(x["node"]["rank"].alias("block"), x["steps"].alias("above")))
    return blocks, stage(found, "paths"), roots


def source_forest(subroots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tree of all sources' roots (key, root); its nodes carry the source's key as ``of``."""
    nodes = subroots.select(F.lit("").alias("key"), F.col("key").alias("of"), F.col("root").alias("hash"))
    return forest(ranked(nodes, ["of"]), "of")


def root_of(docs: DataFrame) -> str | None:
    """The root alone, null for an empty table; it changes with any row, whatever the rows' places."""
    found = source_forest(forest(ranked(stage(leaves(docs), "leaves"), ["doc_id", "hash"]))[2])[2].first()
    return found.root if found else None


def manifest(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """Leaf, roots and proof of every document, and whether its (tampered) leaf folds to the root.

    doc_id, leaf, subroot (of its source), root, proof_sha256 (digest of all siblings on the
    way up), folded_root (from the leaf of ``tampered_text`` where that is not null), verified.
    """
    rows = ranked(stage(leaves(docs, tampered_text), "leaves"), ["doc_id", "hash"])
    blocks, paths, subroots = forest(rows, "doc_id", "other")

    over, over_paths, roots = source_forest(subroots)
    found = roots.first()
    root = F.lit(found.root if found else None).cast("string")
    ends = climbed(over, over_paths, lambda x: F.struct(
        x["node"]["of"].alias("of"), x["node"]["hash"].alias("subroot"), x["steps"].alias("end")))
    whole = paths.join(ends.select(F.col("of").alias("key"), "subroot", "end"), "key").select(
        "key", "block", "subroot", F.concat("above", "end").alias("above"))

    def proof(x: Column) -> Column:
        node, steps = x["node"], x["steps"]
        folded = F.aggregate(
            steps, F.coalesce(node["other"], node["hash"]), lambda h, s: digest(s["before"], h, s["after"]))
        siblings = F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")
        return F.struct(
            node["doc_id"].alias("doc_id"), node["hash"].alias("leaf"),
            F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"),
        )

    return climbed(blocks, whole, proof).select(
        "doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )

