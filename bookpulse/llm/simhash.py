"""Near-duplicates by SimHash: majority bits of word-shingle hashes, linked within a Hamming radius.

Candidates share all bits of two of ``radius + 2`` bit blocks (two texts within the radius
always do for some pair of blocks). Groups of candidates are compared bit-sliced: bit
planes of 64 fingerprints stand in one word each, carry-save counters add up 64 distances
at a time, and a block is abandoned once all its distances exceed the radius.

Rows: a null or empty text has fingerprint zero and is linked like any other; in
``near_duplicates`` rows of one doc_id are one document, and a null doc_id gets a fingerprint
but no component, while ``keep_one`` judges every row by itself; an empty table gives no rows;
very long texts are hashed in runs; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse.llm.common import free_name, importable, own_columns, runs, slices, texts
from bookpulse.session import stage

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Members of a candidate group that one task compares; larger groups are dealt out in blocks.
GROUP = 8192
_CHUNK = 1 << 18
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if 0x09 <= b <= 0x0D else b for b in range(256)
)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text, worked through in runs of bounded size."""
    ones, total, carried = np.zeros(64, dtype=np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for run in runs(text.translate(_FOLD)):
        words = carried + run.split()
        carried = words[max(0, len(words) - shingle + 1):]
        if len(words) < shingle:
            continue
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1) - 1
        first = (ends - lengths)[:len(words) - shingle + 1].tolist()
        last = ends[shingle - 1:].tolist()
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last)), dtype="<u8", count=len(first))
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    if not total:
        if not carried:
            return 0
        return digest(b" ".join(carried), SEED)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_type: str = "bigint") -> DataFrame:
    """doc_id (cast to ``id_type``) and fp (the 64 bits as a signed long) of every row."""
    importable(docs.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, shingle) for t in texts(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast(id_type), "text")
    return rows.mapInArrow(compute, f"doc_id {id_type}, fp bigint")


def block_masks(radius: int) -> list[int]:
    """For each table the bits that its key holds: two of ``radius + 2`` blocks of the 64 bits."""
    cuts = [64 * i // (radius + 2) for i in range(radius + 3)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count is over ``radius``."""
    more, same = np.zeros_like(counters[0]), np.full_like(counters[0], _ALL)
    for k in range(len(counters) - 1, -1, -1):
        if (radius >> k) & 1:
            same &= counters[k]
        else:
            more |= same & counters[k]
            same &= ~counters[k]
    return more


def close_pairs(
    fps: np.ndarray, query: tuple[np.ndarray, np.ndarray], target: tuple[np.ndarray, np.ndarray],
    bits: list[int], radius: int,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) within ``radius`` on ``bits``, for groups of query and target ranges.

    Ranges are (starts, ends) into ``fps``, one per group; targets do not overlap.
    """
    starts, ends = target
    per_group = (ends - starts + 63) // 64
    group = np.repeat(np.arange(len(starts)), per_group)
    first = starts[group] + 64 * (np.arange(len(group)) - np.repeat(np.cumsum(per_group) - per_group, per_group))
    count = np.minimum(64, ends[group] - first)
    # Vertical planes: word [b, k] holds bit b of the up to 64 members of block k.
    block = np.repeat(np.arange(len(first)), count)
    at = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
    members, lanes = fps[first[block] + at], at.astype(np.uint64)
    heads = np.cumsum(count) - count
    planes = {b: np.bitwise_or.reduceat(((members >> np.uint64(b)) & np.uint64(1)) << lanes, heads) for b in bits}
    full = np.bitwise_or.reduceat(np.uint64(1) << lanes, heads)

    queries = (query[1] - query[0])[group]  # combinations of each block with its group's queries
    upto = np.cumsum(queries)
    total = int(upto[-1]) if len(upto) else 0
    width = max(1, radius.bit_length())
    for begin in range(0, total, _CHUNK):
        combo = np.arange(begin, min(total, begin + _CHUNK))
        k = np.searchsorted(upto, combo, side="right")
        i = query[0][group[k]] + combo - (upto[k] - queries[k])
        # Only later members count: lanes up to the query's own are over from the start.
        behind = np.clip(i - first[k] + 1, 0, 64)
        over = np.where(behind >= 64, _ALL, (np.uint64(1) << np.minimum(behind, 63).astype(np.uint64)) - np.uint64(1))
        over |= ~full[k]
        counters = [np.zeros(len(k), dtype=np.uint64) for _ in range(width)]
        for step in range(0, len(bits), 8):
            alive = over != _ALL
            if not alive.all():  # abandon the blocks of which every distance is too large
                k, i, over = k[alive], i[alive], over[alive]
                counters = [c[alive] for c in counters]
            if not len(k):
                break
            own = fps[i]
            for b in bits[step:step + 8]:
                carry = planes[b][k] ^ (np.uint64(0) - ((own >> np.uint64(b)) & np.uint64(1)))
                for c in counters:
                    c ^= carry
                    carry &= ~c
                over |= carry
            over |= _exceeds(counters, radius)
        near = ~over
        some = near != 0
        if some.any():
            words = near[some].astype("<u8").view(np.uint8).reshape(-1, 8)
            row, lane = np.nonzero(np.unpackbits(words, axis=1, bitorder="little"))
            yield i[some][row], first[k[some][row]] + lane


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the labels (smallest index of a component) along the pairs, in place."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            next_label = label[label]
            if (next_label == label).all():
                break
            label[:] = next_label


def links(classes: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """Spanning links (a, b) between classes (fp, rep) within ``radius``; no link is lost.

    Every candidate group yields at most one link per member. A group of more than
    ``group`` members is cut into hashed blocks and each pair of blocks is a task's work of
    its own, so no task holds an unbounded group.
    """
    importable(classes.sparkSession)
    masks = block_masks(radius)
    table = F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for t, m in enumerate(masks)
    ])).alias("c")
    rows = classes.select("fp", "rep", table).select("c.t", "c.key", "fp", "rep")
    large = stage(
        rows.groupBy("t", "key").count().where(F.col("count") > group)
        .select("t", "key", F.ceil(F.col("count") / group).cast("int").alias("parts")),
        "large-groups",
    )
    part = F.pmod(F.hash("fp", "rep"), F.coalesce("parts", F.lit(1)))
    others = F.transform(
        F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1),
        lambda o: F.struct(F.least("p", o).alias("a"), F.greatest("p", o).alias("b")),
    )
    dealt = (
        rows.join(large, ["t", "key"], "left").withColumn("p", part)
        .select("t", "key", F.explode(others).alias("pair"), "p", "fp", "rep")
        .select("t", "key", "pair.a", "pair.b", "p", "fp", "rep")
    )
    where = ["t", "key", "a", "b"]
    return (
        dealt.repartition(*where).sortWithinPartitions(*where, "p", "rep")
        .mapInArrow(lambda batches: _compare(batches, masks, radius), "a bigint, b bigint").distinct()
    )


def _compare(batches: Iterator[pa.RecordBatch], masks: list[int], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of the groups in a sorted stream of (t, key, a, b, p, fp, rep); keeps one open group."""
    kept: list[np.ndarray] | None = None

    def work(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        changed = np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)
        starts = np.concatenate([[0], np.flatnonzero(changed) + 1])
        ends = np.concatenate([starts[1:], [len(columns[0])]])
        several = ends - starts > 1
        starts, ends = starts[several], ends[several]
        t, a, b, p, rep = columns[0], columns[2], columns[3], columns[4], columns[6]
        fps = columns[5].view(np.uint64)
        label = np.arange(len(fps))
        # In a task for two blocks, those of the first are compared with those of the second.
        two = a[starts] != b[starts]
        second = np.concatenate([[0], np.cumsum(p == b)])
        middle = np.where(two, ends - (second[ends] - second[starts]), starts)
        for number in np.unique(t[starts]):
            own = t[starts] == number
            bits = [x for x in range(64) if not (masks[number] >> x) & 1]
            queries = (starts[own], np.where(two, middle, ends)[own])
            filled = (middle < ends)[own]
            query = (queries[0][filled], queries[1][filled])
            for i, j in close_pairs(fps, query, (middle[own][filled], ends[own][filled]), bits, radius):
                join_labels(label, i, j)
        tied = np.flatnonzero(label != np.arange(len(label)))
        if len(tied):
            yield pa.RecordBatch.from_arrays([pa.array(rep[tied]), pa.array(rep[label[tied]])], ["a", "b"])

    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if kept is not None:
            columns = [np.concatenate(pair) for pair in zip(kept, columns)]
        if not len(columns[0]):
            continue
        # The last group may go on in the next batch.
        same = np.all([c == c[-1] for c in columns[:4]], axis=0)
        open_from = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if open_from:
            yield from work([c[:open_from] for c in columns])
        kept = [c[open_from:] for c in columns]
    if kept is not None and len(kept[0]):
        yield from work(kept)


def components(edges: DataFrame) -> DataFrame:
    """vertex and component (its smallest vertex) of every vertex in ``edges`` (a, b).

    Alternates large-star and small-star steps until nothing changes; every round is
    written to the shared folder, so lineage stays short and lost executors cost one round.
    """
    upper = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = stage(edges.where("a <> b").select(*upper).distinct(), "links")
    mark = None
    while True:
        found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if found == mark or not found[0]:
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
        mark = found
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(smallest.select("a", F.col("m").alias("b")))
        )
        now = stage(small.distinct(), "links")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) per row."""
    fps = stage(fingerprints(docs, shingle), "fingerprints")
    classes = stage(
        fps.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("rep")),
        "classes",
    )
    # Rows of one doc_id with different texts tie their classes together.
    tied = (
        fps.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y"))
        .where("x <> y").select("doc_id")
    )
    ties = fps.join(tied, "doc_id").join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    edges = links(classes, radius, group).unionByName(ties)
    found = components(edges)
    classed = classes.join(found, classes.rep == found.vertex, "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return fps.join(classed, "fp", "left").select(
        "doc_id", hex_digits(F.col("fp")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def row_key(docs: DataFrame) -> Column:
    """Digest of a row's doc_id and text (null: empty): equal for repeated rows only."""
    doc_id, text = F.col("`doc_id`").cast("string"), F.col("`text`").cast("string")
    return F.md5(F.concat(F.coalesce(doc_id, F.lit("-")), F.lit(":"), F.coalesce(text, F.lit(""))))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Of each component of linked texts one row: that of the smallest doc_id, then digest; null ids last.

    Rows are linked, chosen and dropped by themselves: rows of one doc_id are as independent
    as any others, and rows without a doc_id are linked as well. Texts move only if the
    table of dropped rows is too large for Spark to broadcast, or where a kept row is repeated.
    """
    key, dropped_key = free_name(docs, "row_key"), free_name(docs, "dropped_key")
    fps = stage(
        fingerprints(docs.select(F.struct(F.col("`doc_id`").cast("bigint").alias("doc_id"), row_key(docs).alias("key"))
                                 .alias("doc_id"), F.col("`text`").alias("text")), shingle,
                     "struct<doc_id:bigint,key:string>").select("doc_id.*", "fp"),
        "fingerprints",
    )
    classes = stage(fps.select("fp", F.col("fp").alias("rep")).distinct(), "classes")
    found = components(links(classes, radius))
    component = F.coalesce("component", "fp").alias("component")
    rows = stage(fps.join(found, fps.fp == found.vertex, "left").select("doc_id", "key", component), "components")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first"))
    judged = stage(
        rows.groupBy("component", "key").agg(F.count("*").alias("n"), F.min("doc_id").alias("id")).join(
            first.select("component", F.col("first.key").alias("kept")), "component")
        .select("id", "n", F.col("key").alias(dropped_key), (F.col("key") == F.col("kept")).alias("stays")),
        "judged",
    )
    # Most ids go as a whole: a narrow table. The others' rows, and rows without an id, go by their keys.
    whole = stage(
        judged.where("id IS NOT NULL").groupBy("id").agg(F.bool_or("stays").alias("stays")).where("NOT stays").select("id"),
        "dropped-ids",
    )
    apart = stage(judged.where("NOT stays").join(whole, "id", "left_anti").select(dropped_key), "dropped-rows")
    repeated = stage(judged.where("stays AND n > 1").select(dropped_key), "repeated")
    kept = docs.join(whole, docs["`doc_id`"] == whole["id"], "left_anti")
    if apart.isEmpty() and repeated.isEmpty():
        return kept
    kept = kept.withColumn(key, row_key(docs))
    kept = kept.join(apart, kept[key] == apart[dropped_key], "left_anti")
    if repeated.isEmpty():
        return kept.drop(key)
    again = kept[key] == repeated[dropped_key]
    once = kept.join(repeated, again, "left_semi").dropDuplicates([key])
    return kept.join(repeated, again, "left_anti").unionByName(once).drop(key)
