"""Gradient-boosted trees on histograms, many models at a time.

Inputs become byte-sized bins, between quantiles of the whole table. For a level of a tree,
gradients and hessians are added up per (model, node, input, bin), only for the smaller child of
each pair, since its sibling is the parent less it; the sums, whose size does not depend on the
rows, give the second-order splits. A bounded number of rows (``TASK_ROWS``) is boosted within
one task per model, where a job per level would be nothing but waiting. More rows are dealt to many
tasks: a level is one job that adds up their sums, and the rows' scores stay with them,
checkpointed every few trees, so a lost executor costs a few trees of its own rows.

Several models (one per fold, say) share bins and jobs: they differ in the rows left out only.
Gradients are added as whole numbers, and rows and inputs are drawn by hashes of a row's key
and the number of the tree, so neither partitions nor their order change a model.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookpulse.session import importable, keep_checkpoints

BINS = 64
PENALTY, LEAST_HESSIAN, LEAST_GAIN = 1.0, 1.0, 1e-6
#: Gradients are counted in units of 2 ** -32: sums of 2 ** 31 rows fit.
_UNIT = float(1 << 32)
#: Rows that one task boosts (of many tasks, about so many each), most tasks, trees between checkpoints.
TASK_ROWS, MOST_TASKS, CHECKPOINT = 1 << 18, 4096, 25
_CHUNK = 1 << 20
_MASK = (1 << 64) - 1
_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(keys: np.ndarray, turn: int) -> np.ndarray:
    """64 well-mixed bits per key, others for every turn."""
    z = keys.astype(np.uint64) + np.uint64((turn + 1) * _ODD[0] & _MASK)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(_ODD[1])
    z = (z ^ (z >> np.uint64(27))) * np.uint64(_ODD[2])
    return z ^ (z >> np.uint64(31))


def drawn(keys: np.ndarray, turn: int, share: float) -> np.ndarray:
    """True for about ``share`` of the keys."""
    return (mixed(keys, turn) >> np.uint64(32)) < np.uint64(share * (1 << 32))


def row_key(column: Column) -> Column:
    """60 bits of a row's name."""
    return F.conv(F.substring(F.md5(column.cast("string")), 1, 15), 16, 10).cast("bigint")


@dataclass
class Tree:
    """A complete binary tree; where ``feature`` is -1 all rows go left."""

    feature: np.ndarray  # of 2 ** depth - 1 nodes, first to last level
    bin: np.ndarray      # rows of at most this bin go left
    gain: np.ndarray
    cover: np.ndarray    # hessian of the drawn rows
    value: np.ndarray    # of 2 ** depth leaves, learning rate included

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """Number of the leaf of each row; bins: one line per input."""
        return descend(bins, self.feature, self.bin, int(math.log2(len(self.value)))) - len(self.feature)


def step(bins: np.ndarray, feature: np.ndarray, split: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The node of each row one level further down."""
    n = bins.shape[1]
    start = np.maximum(feature, 0) * n                   # where an input's line begins
    most = np.where(feature < 0, 255, split).astype("u1")  # bins are bytes: without a split all go left
    right = bins.reshape(-1).take(start.take(node) + np.arange(n)) > most.take(node)
    return 2 * node + 1 + right


def descend(bins: np.ndarray, feature: np.ndarray, split: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row after so many levels."""
    node = np.zeros(bins.shape[1], dtype=np.int64)
    for _ in range(levels):
        node = step(bins, feature, split, node)
    return node


@dataclass
class BoostedTrees:
    """A fitted model: small, and the same for any partitioning of its rows."""

    inputs: tuple[str, ...]
    edges: list[np.ndarray]
    base: float
    rate: float
    trees: list[Tree] = field(default_factory=list)

    @property
    def depth(self) -> int:
        """Levels of the deepest tree."""
        return max((_levels(t) for t in self.trees), default=0)

    def bins(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """Per input the number of edges below each value."""
        return np.stack([np.searchsorted(e, np.asarray(x, dtype=np.float64)) for e, x in zip(self.edges, columns)])

    def margins(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        bins = self.bins(columns)
        total = np.full(bins.shape[1], self.base)
        for tree in self.trees:
            total += tree.value[tree.leaves(bins)]
        return total

    def importances(self) -> np.ndarray:
        """Mean gain of each input's splits, in shares of all."""
        gain, n = np.zeros(len(self.inputs)), np.zeros(len(self.inputs))
        for tree in self.trees:
            split = tree.feature >= 0
            np.add.at(gain, tree.feature[split], tree.gain[split])
            np.add.at(n, tree.feature[split], 1)
        mean = gain / np.maximum(n, 1)
        return mean / mean.sum() if mean.sum() > 0 else np.full(len(mean), 1 / max(len(mean), 1))

    def nodes(self) -> list[tuple]:
        """(tree, node, input, threshold, gain, cover, value) of every split and reached leaf."""
        out = []
        for t, tree in enumerate(self.trees):
            for n, f in enumerate(tree.feature):
                if f >= 0:
                    edge = float(self.edges[f][tree.bin[n]])
                    out.append((t, n, self.inputs[f], edge, float(tree.gain[n]), float(tree.cover[n]), None))
            out += [
                (t, len(tree.feature) + n, None, None, None, float(tree.cover[len(tree.feature) + n]), float(v))
                for n, v in enumerate(tree.value) if tree.cover[len(tree.feature) + n] > 0
            ]
        return out


NODES = "tree int, node int, input string, threshold double, gain double, cover double, value double"
_HEAD = "inputs array<string>, edges array<array<double>>, base double, rate double, rounds int, depth int"


def _levels(tree: Tree) -> int:
    used = np.flatnonzero(tree.feature >= 0)
    return int(math.log2(used[-1] + 1)) + 1 if len(used) else 0


def node_table(model: BoostedTrees) -> DataFrame:
    """Splits and leaves of all trees."""
    return SparkSession.active().createDataFrame(model.nodes(), NODES)


def save(model: BoostedTrees, path: str) -> None:
    """Replace the model at ``path``: its nodes, then its head."""
    spark = SparkSession.active()
    levels = int(math.log2(len(model.trees[0].value))) if model.trees else 0
    head = (list(model.inputs), [e.tolist() for e in model.edges], model.base, model.rate, len(model.trees), levels)
    node_table(model).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([head], _HEAD).coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def load(path: str) -> BoostedTrees:
    spark = SparkSession.active()
    head = spark.read.schema(_HEAD).parquet(f"{path}/metadata").first()
    model = BoostedTrees(tuple(head.inputs), [np.array(e) for e in head.edges], head.base, head.rate)
    place = {name: i for i, name in enumerate(model.inputs)}
    model.trees = [_empty_tree(head.depth) for _ in range(head.rounds)]
    for r in spark.read.schema(NODES).parquet(f"{path}/nodes").collect():  # at most 2 ** (depth + 1) a round
        tree = model.trees[r.tree]
        tree.cover[r.node] = r.cover
        if r.input is None:
            tree.value[r.node - len(tree.feature)] = r.value
        else:
            f = place[r.input]
            tree.feature[r.node], tree.gain[r.node] = f, r.gain
            tree.bin[r.node] = int(np.searchsorted(model.edges[f], r.threshold))
    return model


def _empty_tree(depth: int) -> Tree:
    inner = 2 ** depth - 1
    return Tree(np.full(inner, -1), np.zeros(inner, dtype=np.int64), np.zeros(inner), np.zeros(2 * inner + 1), np.zeros(inner + 1))


def with_probability(model: BoostedTrees, df: DataFrame, name: str) -> DataFrame:
    """Add the probability of class 1; inputs reach Python in Arrow batches."""
    importable(df.sparkSession)

    @F.pandas_udf("double")
    def probability(*columns: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-model.margins([c.to_numpy() for c in columns]))))

    return df.withColumn(name, probability(*[F.col(c).cast("double") for c in model.inputs]))


def quantile_edges(df: DataFrame, inputs: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Distinct inner quantiles of each input: one aggregate of sketches, exact up to some thousand rows."""
    shares = [k / bins for k in range(1, bins)]
    found = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(c) for c in inputs]).first()
    return [np.unique(np.array(found[c] or [], dtype=np.float64)) for c in inputs]


class Rows:
    """The rows of one task: keys, labels, folds, bins, and a margin per model."""

    def __init__(self, batches: Iterator[pa.RecordBatch], models: Sequence[BoostedTrees]):
        kinds, n_inputs = ("<i8", "u1", "i1"), len(models[0].inputs)
        parts: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
        bins = [np.zeros((n_inputs, 0), "u1")]
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for part, column, kind in zip(parts, columns, kinds):
                part.append(column.astype(kind))
            bins.append(models[0].bins(columns[len(kinds):]).astype("u1"))
        self.keys, self.labels, self.folds = (np.concatenate(p) for p in parts)
        self.bins = np.concatenate(bins, axis=1)
        self.margins = [np.full(len(self.keys), m.base) for m in models]

    def move(self, trees: Sequence[Tree]) -> Rows:
        """Add a further tree of each model to the margins."""
        for margin, tree in zip(self.margins, trees):
            margin += tree.value[tree.leaves(self.bins)]
        return self

    def drawn(self, left_out: Sequence[int], turn: int, share: float) -> list[Drawn]:
        """Per model the rows drawn for a tree, with their gradients and hessians."""
        sample, out = drawn(self.keys, turn, share), []
        for margin, fold in zip(self.margins, left_out):
            rows = np.flatnonzero(sample & (self.folds != fold) if fold >= 0 else sample)
            p = 1 / (1 + np.exp(-margin[rows]))
            out.append(Drawn(
                self.bins.take(rows, axis=1), np.rint((p - self.labels[rows]) * _UNIT), np.rint(p * (1 - p) * _UNIT)
            ))
        return out


class Drawn:
    """Rows drawn for one tree of one model: bins, whole gradients and hessians, the node each has reached."""

    def __init__(self, bins: np.ndarray, gradients: np.ndarray, hessians: np.ndarray):
        self.bins, self.weights, self.level = bins, (gradients, hessians), 0
        self.node = np.zeros(bins.shape[1], dtype=np.int64)

    def down(self, tree: Tree, level: int) -> None:
        """Move the rows on to this level; they stay there for the next one."""
        for _ in range(self.level, level):
            self.node = step(self.bins, tree.feature, tree.bin, self.node)
        self.level = level

    def sums(self, columns: np.ndarray, bins: int, level: int, tree: Tree, counted: np.ndarray, n_nodes: int) -> np.ndarray:
        """[gradient or hessian, counted node, input, bin] of these rows.

        ``counted``: per node of the level its place among the nodes that are added up, or -1.
        """
        self.down(tree, level)
        out = np.zeros((2, n_nodes, len(columns), bins), dtype=np.int64)
        at, rows, weights = counted[self.node - (2 ** level - 1)], None, self.weights
        if at.min(initial=0) < 0:
            rows = np.flatnonzero(at >= 0)
            at, weights = at[rows], [w[rows] for w in weights]
        cells = at * bins
        for c, column in enumerate(columns):
            own = self.bins[column] if rows is None else self.bins[column].take(rows)
            cell = cells + own
            # Weighted counts are doubles, exact below 2 ** 53: a weight is at most 2 ** 32, a chunk 2 ** 20 rows.
            for start in range(0, len(cell), _CHUNK):
                part = slice(start, start + _CHUNK)
                for k, values in enumerate(weights):
                    out[k, :, c] += np.bincount(cell[part], values[part], n_nodes * bins).astype(np.int64).reshape(n_nodes, bins)
        return out


def _all_sums(rows: Sequence[Drawn], columns: np.ndarray, bins: int, level: int, trees: Sequence[Tree], counted: np.ndarray) -> np.ndarray:
    """[gradient or hessian, model, counted node, input, bin], of the rows of every model."""
    n_nodes = int(counted.max()) + 1
    return np.stack([r.sums(columns, bins, level, t, c, n_nodes) for r, t, c in zip(rows, trees, counted)], axis=1)


def _best_splits(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node the best (input, bin, gain); gain 0 where no split is worth it. sums: [2, node, input, bin]."""
    left = np.cumsum(sums, axis=3) / _UNIT
    total = left[:, :, :, -1:]
    right = total - left

    def worth(part: np.ndarray) -> np.ndarray:
        return part[0] * part[0] / (part[1] + PENALTY)

    gain = worth(left) + worth(right) - worth(total)
    gain = np.where((left[1] >= LEAST_HESSIAN) & (right[1] >= LEAST_HESSIAN), gain, 0.0)
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)  # the first of equals: first input, smallest bin
    found = flat[np.arange(len(flat)), best]
    return best // gain.shape[2], best % gain.shape[2], np.where(found > LEAST_GAIN, found, 0.0)


def columns_of(turn: int, n: int, share: float) -> np.ndarray:
    """The inputs that a tree may use."""
    return np.sort(np.argsort(mixed(np.arange(1, n + 1), -turn - 2), kind="stable")[:max(1, int(share * n))])


def _split_level(columns: np.ndarray, bins: int, level: int, trees: list[Tree], above: np.ndarray | None, sums_of) -> np.ndarray:
    """Split all nodes of a level; returns their sums [2, model, node, input, bin].

    ``sums_of(level, trees, counted)`` gives the sums of all rows. The last level also gives its children, the leaves, their sums.
    """
    n, first = 2 ** level, 2 ** level - 1
    if above is None:
        counted = np.zeros((len(trees), 1), dtype=np.int64)
    else:  # of two children the one with less hessian is counted
        counted = np.full((len(trees), n), -1)
        for m, tree in enumerate(trees):
            pairs = tree.cover[first:first + n].reshape(-1, 2)
            counted[m, 2 * np.arange(n // 2) + (pairs[:, 1] < pairs[:, 0])] = np.arange(n // 2)
    found = sums_of(level, trees, counted)
    sums = np.zeros((2, len(trees), n, len(columns), bins), dtype=np.int64)
    for m, tree in enumerate(trees):
        chosen = np.flatnonzero(counted[m] >= 0)
        sums[:, m, chosen] = found[:, m, counted[m][chosen]]
        if above is not None:
            sums[:, m, chosen ^ 1] = above[:, m] - sums[:, m, chosen]
        column, split, gain = _best_splits(sums[:, m])
        worth = gain > 0
        nodes = first + np.arange(n)
        tree.feature[nodes], tree.bin[nodes] = np.where(worth, columns[column], -1), np.where(worth, split, 0)
        tree.gain[nodes] = gain
        whole = sums[:, m, :, 0].sum(axis=2)
        left = np.where(worth, np.take_along_axis(
            np.cumsum(sums[:, m], axis=3)[:, np.arange(n), column], split[None, :, None], axis=2)[:, :, 0], whole)
        children = np.stack([left, whole - left], axis=2).reshape(2, 2 * n) / _UNIT
        tree.cover[nodes] = whole[1] / _UNIT
        tree.cover[2 * first + 1:2 * first + 1 + 2 * n] = children[1]
        if len(tree.value) == 2 * n:
            tree.value[:] = children[0]
    return sums


def _grown(models: Sequence[BoostedTrees], columns: np.ndarray, bins: int, depth: int, sums_of) -> list[Tree]:
    """One tree for each model, its leaves weighted."""
    trees, sums = [_empty_tree(depth) for _ in models], None
    for level in range(depth):
        sums = _split_level(columns, bins, level, trees, sums, sums_of)
    first = 2 ** depth - 1
    for model, tree in zip(models, trees):
        leaf = tree.cover[first:] > 0
        tree.value[leaf] = -model.rate * tree.value[leaf] / (tree.cover[first:][leaf] + PENALTY)
        model.trees.append(tree)
    return trees


def _boosted_here(rows: Rows, models: Sequence[BoostedTrees], left_out: Sequence[int], turns: range, depth: int,
                  row_share: float, column_share: float, bins: int) -> None:
    """Add a tree per turn to every model, all rows being at hand."""
    for turn in turns:
        columns, chosen = columns_of(turn, len(models[0].inputs), column_share), rows.drawn(left_out, turn, row_share)
        rows.move(_grown(models, columns, bins, depth, lambda level, trees, counted, d=chosen, c=columns: _all_sums(
            d, c, bins, level, trees, counted)))


def _boosted_apart(parts: RDD, models: Sequence[BoostedTrees], left_out: Sequence[int], turns: range, depth: int,
                   row_share: float, column_share: float, bins: int) -> None:
    """The same for rows in many partitions: one job a level adds up their sums, margins stay where the rows are."""
    parts, older = parts.persist(StorageLevel.MEMORY_AND_DISK), None
    for k, turn in enumerate(turns, 1):
        columns = columns_of(turn, len(models[0].inputs), column_share)

        def sums_of(level: int, trees: list[Tree], counted: np.ndarray, turn=turn, columns=columns) -> np.ndarray:
            splits = [Tree(t.feature, t.bin, *[np.zeros(0)] * 3) for t in trees]
            found = parts.map(lambda rows: _all_sums(
                rows.drawn(left_out, turn, row_share), columns, bins, level, splits, counted))
            return sum(found.collect()) if found.getNumPartitions() <= 32 else found.treeReduce(np.add)

        trees = _grown(models, columns, bins, depth, sums_of)
        if k == len(turns):
            break
        moved = parts.map(lambda rows, trees=trees: rows.move(trees)).persist(StorageLevel.MEMORY_AND_DISK)
        if k % CHECKPOINT == 0:
            moved.checkpoint()
            moved.count()
        if older is not None:
            older.unpersist()
        parts, older = moved, parts
    for last in filter(None, (parts, older)):
        last.unpersist()


def fit(
    df: DataFrame, inputs: Sequence[str], label: str, key: str, rounds: int, depth: int, rate: float,
    row_share: float = 1.0, column_share: float = 1.0, seed: int = 0, fold: str | None = None,
    left_out: Sequence[int] = (-1,), bins: int = BINS, task_rows: int = TASK_ROWS,
) -> list[BoostedTrees]:
    """One model for each entry of ``left_out``: fitted to the rows of all other folds (-1: of all).

    Pass a written table: it is read for the quantiles, the mean label and the rows.
    """
    spark = importable(df.sparkSession)
    edges = quantile_edges(df, inputs, bins)
    by_fold = df.groupBy((F.col(fold) if fold else F.lit(-1)).alias("k")).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("y"))
    counts = {r.k: (r.n, r.y) for r in by_fold.collect()}  # one row per fold
    models = []
    for out in left_out:
        n, y = (sum(x) for x in zip((0, 0), *(c for k, c in counts.items() if out < 0 or k != out)))
        p = min(max(y / n, 1e-6), 1 - 1e-6) if n else 0.5
        models.append(BoostedTrees(tuple(inputs), edges, math.log(p / (1 - p)), rate))
    if not counts:
        return models
    turns = range(seed * 1_000_003, seed * 1_000_003 + rounds)
    options = left_out, turns, depth, row_share, column_share, bins
    tasks = math.ceil(sum(n for n, _ in counts.values()) / task_rows)
    rows = df.select(
        row_key(F.col(key)).alias("key"), F.col(label).cast("int").alias("label"),
        (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"),
        *[F.col(c).cast("double").alias(f"input{i}") for i, c in enumerate(inputs)],
    )
    if tasks > 1:
        keep_checkpoints(spark)
        dealt = rows.repartition(min(tasks, MOST_TASKS), "key")
        apart = dealt.mapInArrow(lambda batches: _packed(Rows(batches, models)), "rows binary").rdd
        _boosted_apart(apart.map(lambda r: pickle.loads(r[0])), models, *options)
        return models

    names = rows.columns

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first in batches:
            k = first.column("model")[0].as_py()
            own = Rows((b.select(names) for b in chain([first], batches)), models[k:k + 1])
            _boosted_here(own, models[k:k + 1], left_out[k:k + 1], *options[1:])
            yield from _packed((k, models[k].trees))

    each = rows.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(len(models) - 1))))
    for found in each.repartitionById(len(models), "model").mapInArrow(train, "trees binary").collect():
        k, models[k].trees = pickle.loads(found.trees)
    return models


def _packed(value: object) -> Iterator[pa.RecordBatch]:
    """A value made by this module, as one row."""
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(value)], pa.large_binary()).cast(pa.binary())], ["value"])
