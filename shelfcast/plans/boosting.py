"""Boosted regression trees: grown round by round with Spark ML, kept as a table of nodes.

A round is one tree on what the rounds before it left over, a column of the training rows.
Rounds go in blocks: inside a block each tree is taken off the column of the round before; after it
the rows are checkpointed with the new column, and all errors of the block are read in one pass. So
growth goes on from where it is, and the size of a block changes no tree.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.sources.staging import checkpoint


@dataclass(frozen=True)
class TreeSettings:
    """What the trees are grown with; growth ends when ``patience`` rounds brought no gain.

    ``rounds`` bounds growth that would never end. ``block`` rounds pass between checkpoints.
    """

    rounds: int = 4000
    patience: int = 150
    block: int = 10
    learning_rate: float = 0.05
    leaves: int = 128
    min_rows: int = 50
    row_share: float = 0.8
    feature_share: float = 0.8
    bins: int = 64
    level_smoothing: float = 10.0
    folds: int = 5
    seed: int = 42

    @property
    def depth(self) -> int:
        return max(1, round(math.log2(self.leaves)))


#: Rows that a block reads again and again; what is lost is computed anew from the last checkpoint.
KEPT = StorageLevel.MEMORY_AND_DISK

#: A node by its place in a full binary tree, whose children are 2n + 1 and 2n + 2. A leaf has no
#: feature. ``left`` holds the categories that go left, in place of a threshold.
NODES = "tree int, place int, feature int, threshold double, left array<double>, value double"
TREES = "array<array<struct<feature:int,threshold:double,left:array<double>,value:double>>>"
Node = tuple[int | None, float | None, list[float] | None, float | None]
Tree = dict[int, Node]

_IF = re.compile(r"If \(feature (\d+) (?:<= (\S+)|in \{(.*)\})\)")
_LEAF = re.compile(r"Predict: (\S+)")


def _nodes(lines: Iterator[str], place: int, tree: Tree) -> None:
    line = next(lines)
    if leaf := _LEAF.fullmatch(line):
        tree[place] = (None, None, None, float(leaf[1]))
        return
    feature, threshold, categories = _IF.fullmatch(line).groups()
    left = None if categories is None else [float(c) for c in categories.split(",") if c]
    tree[place] = (int(feature), None if threshold is None else float(threshold), left, None)
    _nodes(lines, 2 * place + 1, tree)
    next(lines)  # Else
    _nodes(lines, 2 * place + 2, tree)


def described_trees(description: str) -> list[Tree]:
    """The trees in the description that a Spark ML tree model gives of itself."""
    trees: list[Tree] = []
    parts = re.split(r"^ *Tree \d+ \(weight .*\):$", description, flags=re.MULTILINE)
    for part in parts[1:]:
        trees.append({})
        _nodes(iter([line.strip() for line in part.splitlines() if line.strip()]), 0, trees[-1])
    return trees


def node_table(spark: SparkSession, trees: list[Tree]) -> DataFrame:
    rows = [(t, place, *node) for t, tree in enumerate(trees) for place, node in sorted(tree.items())]
    return spark.createDataFrame(rows, NODES)


def trees_of(nodes: DataFrame) -> list[Tree]:
    """The trees of a node table; a model has ``rounds`` times twice ``leaves`` rows at most."""
    trees: dict[int, Tree] = {}
    for r in nodes.collect():
        left = None if r["left"] is None else list(r["left"])
        trees.setdefault(r["tree"], {})[r["place"]] = (r["feature"], r["threshold"], left, r["value"])
    return [trees[t] for t in sorted(trees)]


def as_column(trees: list[Tree]) -> Column:
    """The trees as one constant: for each an array of nodes by place."""
    names = ("feature", "threshold", "left", "value")
    dense = [
        [None if p not in tree else dict(zip(names, tree[p], strict=True)) for p in range(max(tree) + 1)] for tree in trees
    ]
    return F.from_json(F.lit(json.dumps(dense)), TREES)


def _value(x: Column, tree: Column, depth: int) -> Column:
    """The value of the leaf that ``x`` falls in: ``depth`` steps down the array of nodes."""

    def down(place: Column, _: Column) -> Column:
        node = F.get(tree, place)
        value = F.get(x, node["feature"])
        left = F.when(F.isnull(node["left"]), value <= node["threshold"]).otherwise(F.array_contains(node["left"], value))
        return F.when(F.isnull(node["feature"]), place).otherwise(2 * place + F.when(left, 1).otherwise(2))

    place = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), down) if depth else F.lit(0)
    return F.get(tree, place)["value"]


def _depth(trees: list[Tree]) -> int:
    return max(((max(tree) + 1).bit_length() - 1 for tree in trees), default=0)


def tree_values(x: Column, trees: list[Tree]) -> Column:
    """What each tree says of the feature array ``x``, in one array."""
    depth = _depth(trees)
    return F.transform(as_column(trees), lambda tree: _value(x, tree, depth))


def added(start: Column, x: Column, trees: list[Tree], rate: float) -> Column:
    """``start`` plus ``rate`` times what each tree says of ``x``, tree by tree."""
    if not trees:
        return start
    depth = _depth(trees)
    return F.aggregate(as_column(trees), start, lambda total, tree: total + F.lit(rate) * _value(x, tree, depth))


@dataclass
class Ensemble:
    """A start value and trees, each of which counts ``rate`` times.

    ``gains`` is what splits on each feature took off the squared training error, by the
    feature's place; errors are root mean squares after each round grown.
    """

    start: float
    rate: float
    trees: list[Tree]
    gains: list[float]
    train_errors: list[float] = field(default_factory=list)
    valid_errors: list[float] = field(default_factory=list)

    @property
    def rounds(self) -> int:
        return len(self.trees)

    def score(self, x: Column) -> Column:
        return added(F.lit(self.start), x, self.trees, self.rate)


def best_round(errors: list[float], patience: int) -> tuple[int, bool]:
    """The round (from 1) with the least error before ``patience`` rounds without a lesser one, and
    whether growth ends there."""
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def _one_tree(settings: TreeSettings, round_: int) -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol="features",
        labelCol="residual",
        numTrees=1,
        bootstrap=False,
        maxDepth=settings.depth,
        maxBins=settings.bins,
        minInstancesPerNode=settings.min_rows,
        subsamplingRate=settings.row_share,
        featureSubsetStrategy=str(settings.feature_share),
        seed=settings.seed * 1_000_003 + round_,
    )


def _gains_and_errors(valued: DataFrame, n: int, rate: float) -> tuple[list[float], list[float]]:
    """For each of ``n`` trees the squared error it takes off at full weight, and the mean square after it.

    ``valued`` has what is left before the first tree (``before``) and what each tree says (``said``).
    """
    said = [F.get("said", F.lit(k)) for k in range(n)]
    left = [F.col("before")]
    for value in said:
        left.append(left[-1] - F.lit(rate) * value)
    gains = [F.sum(2 * r * v - v * v).alias(f"gain_{k}") for k, (v, r) in enumerate(zip(said, left, strict=False))]
    errors = [F.avg(r * r).alias(f"error_{k}") for k, r in enumerate(left[1:])]
    row = valued.agg(*gains, *errors).first()
    return list(row[:n]), list(row[n:])


def _opened(rows: DataFrame) -> DataFrame:
    """``rows`` (features, residual) at the start of a block, whose trees have said nothing yet."""
    nothing = F.array().cast("array<double>")
    return rows.select("features", F.col("residual").alias("before"), nothing.alias("said"), "residual")


def _taken_off(rows: DataFrame, model: RandomForestRegressionModel, rate: float) -> DataFrame:
    """``rows`` after one more tree, whose values the library's own model gives."""
    value = F.col("prediction")
    said = F.concat("said", F.array(value)).alias("said")
    return model.transform(rows).select("features", "before", said, (F.col("residual") - F.lit(rate) * value).alias("residual"))


def _dense(rows: DataFrame) -> DataFrame:
    """``rows`` (features, label) with vectors that hold all places, in which a tree finds a place at once.

    In a vector of few places each look at one is a search, and a round looks at every place of every row.
    """
    whole = array_to_vector(vector_to_array("features"))
    return rows.select(whole.alias("features", metadata=rows.schema["features"].metadata), "label")


def _spread(rows: DataFrame) -> DataFrame:
    """``rows`` in one partition for each core at least."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return checkpoint(rows.repartition(cores)) if rows.rdd.getNumPartitions() < cores else rows


def grow(train: DataFrame, settings: TreeSettings, valid: DataFrame | None = None, rounds: int | None = None) -> Ensemble:
    """Grow trees on ``train`` (features, label).

    With ``valid`` growth ends after ``patience`` rounds without a lesser error there, and the trees
    up to the least are kept; else ``rounds`` are grown. The driver holds the trees and some numbers
    of each round.
    """
    rate, most = settings.learning_rate, settings.rounds if rounds is None else rounds
    rows = _dense(_spread(checkpoint(train.select("features", "label"))))
    start = rows.agg(F.avg("label")).first()[0] or 0.0
    left_over = (F.col("label") - F.lit(start)).alias("residual")
    rows = rows.select("features", left_over).persist(KEPT)
    held_out = None if valid is None else checkpoint(valid.select("features", left_over))
    trees: list[Tree] = []
    shares: list[tuple[float, list[float]]] = []
    train_errors, valid_errors, ended = [], [], False
    while len(trees) < most and not ended:
        block: list[Tree] = []
        now = before = _opened(rows)
        for round_ in range(len(trees), min(len(trees) + settings.block, most)):
            model = _one_tree(settings, round_).fit(now)
            before.unpersist()
            block += described_trees(model.toDebugString)
            shares.append(model.featureImportances.toArray().tolist())
            before, now = now, _taken_off(now, model, rate).persist(KEPT)
        gains, errors = _gains_and_errors(now, len(block), rate)
        shares[len(trees) :] = [(gain, share) for gain, share in zip(gains, shares[len(trees) :], strict=True)]
        train_errors += errors
        trees += block
        if held_out is not None:
            seen = held_out.select(F.col("residual").alias("before"), tree_values(vector_to_array("features"), block).alias("said"))
            valid_errors += _gains_and_errors(seen, len(block), rate)[1]
            ended = best_round(valid_errors, settings.patience)[1]
        held = [rows, before, now]
        if len(trees) < most and not ended:
            rows = checkpoint(now.select("features", "residual")).persist(KEPT)
            if held_out is not None:
                residual = added(F.col("residual"), vector_to_array("features"), block, -rate)
                held_out = checkpoint(held_out.withColumn("residual", residual))
        for df in held:
            df.unpersist()
    kept = len(trees) if valid is None else best_round(valid_errors, settings.patience)[0]
    gains = [sum(gain * share[i] for gain, share in shares[:kept]) for i in range(len(shares[0][1]) if shares else 0)]
    return Ensemble(
        start, rate, trees[:kept], gains, [math.sqrt(e) for e in train_errors], [math.sqrt(e) for e in valid_errors]
    )
