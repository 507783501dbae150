"""Trees grown in blocks, their node table and its scores against Spark ML's own."""

import random
from dataclasses import replace

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, SparseVector, Vectors, VectorUDT
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from shelfcast.plans import boosting

SETTINGS = boosting.TreeSettings(rounds=80, patience=3, block=4, learning_rate=0.6, leaves=4, min_rows=5, bins=16)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for _ in range(1500):
        a, b, c = rng.random(), rng.randrange(6), rng.random()
        data.append((a, float(b), c, 3 * a + (2.0 if b in (1, 4) else 0.0) + rng.gauss(0, 0.5)))
    df = spark.createDataFrame(data, "a double, b double, c double, label double").repartition(2)
    b = F.col("b").alias("b", metadata={"ml_attr": {"type": "nominal", "name": "b", "num_vals": 6}})
    df = df.select("a", b, "c", "label")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).select("features", "label").cache()


@pytest.fixture(scope="module")
def halves(rows):
    picked = F.pmod(F.xxhash64("label"), F.lit(3)) == 0
    return rows.where(~picked).cache(), rows.where(picked).cache()


def test_scores_are_those_of_the_library(rows):
    model = GBTRegressor(maxIter=6, maxDepth=4, maxBins=16, stepSize=0.4, seed=1).fit(rows)
    trees = boosting.described_trees(model.toDebugString)
    assert len(trees) == 6 and any(n[2] for t in trees for n in t.values())
    x = vector_to_array("features")
    said = boosting.tree_values(x, trees)
    own = sum(F.get(said, F.lit(i)) * w for i, w in enumerate(model.treeWeights))
    both = model.transform(rows).select("prediction", own.alias("own"))
    assert both.where(F.abs(F.col("prediction") - F.col("own")) > 1e-9).isEmpty()


def test_the_size_of_a_block_changes_nothing(halves):
    train, valid = halves
    fits = [boosting.grow(train, replace(SETTINGS, block=n), valid) for n in (3, 50)]
    assert fits[0].trees == fits[1].trees and fits[0].rounds < SETTINGS.rounds
    grown = min(len(f.valid_errors) for f in fits)
    assert fits[0].valid_errors[:grown] == pytest.approx(fits[1].valid_errors[:grown], abs=1e-12)
    assert fits[0].gains == pytest.approx(fits[1].gains)


def test_a_round_reads_whole_vectors_and_walks_no_tree_by_hand(rows, monkeypatch):
    def sparse(v):
        return Vectors.sparse(len(v), {i: x for i, x in enumerate(v.toArray().tolist()) if x})

    meta = rows.schema["features"].metadata
    dealt = rows.select("features", "label").repartition(8).cache()
    thin = dealt.select(F.udf(sparse, VectorUDT())("features").alias("features", metadata=meta), "label")
    assert all(isinstance(r["features"], SparseVector) for r in thin.collect())
    seen, fit = [], RandomForestRegressor.fit

    def watched(self, df, *more):
        seen.append(df)
        kinds.update(type(r["features"]) for r in df.select("features").take(50))
        assert df.schema["features"].metadata == meta
        plans.append(df._jdf.queryExecution().logical().toString())
        return fit(self, df, *more)

    kinds, plans = set(), []
    monkeypatch.setattr(RandomForestRegressor, "fit", watched)
    grown = boosting.grow(thin, SETTINGS, rounds=6)
    assert len(seen) == 6 and kinds == {DenseVector}
    assert not any("from_json" in p for p in plans)
    monkeypatch.setattr(RandomForestRegressor, "fit", fit)
    whole = boosting.grow(dealt, SETTINGS, rounds=6)
    assert grown.trees == whole.trees and grown.gains == pytest.approx(whole.gains)
    # What the library's model takes off in growth is what the node table's walk takes off.
    left = dealt.select(F.avg((F.col("label") - whole.score(vector_to_array("features"))) ** 2)).first()[0]
    assert left**0.5 == pytest.approx(whole.train_errors[-1], abs=1e-12)


def test_growth_ends_at_the_least_error_and_learns(halves):
    train, valid = halves
    fitted = boosting.grow(train, SETTINGS, valid)
    errors = fitted.valid_errors
    assert min(errors[: fitted.rounds + SETTINGS.patience]) == errors[fitted.rounds - 1] < 0.65
    assert 1 <= fitted.rounds and len(errors) < SETTINGS.rounds
    got = valid.select((fitted.score(vector_to_array("features")) - F.col("label")).alias("e")).agg(F.sqrt(F.avg(F.col("e") ** 2))).first()[0]
    assert got == pytest.approx(errors[fitted.rounds - 1], abs=1e-9)
    assert fitted.gains[0] > fitted.gains[2] and fitted.gains[1] > fitted.gains[2] >= 0


def test_a_fixed_number_of_rounds(spark, halves):
    fitted = boosting.grow(halves[0], SETTINGS, rounds=9)
    assert fitted.rounds == 9 and fitted.valid_errors == []
    assert fitted.train_errors == sorted(fitted.train_errors, reverse=True)
    assert boosting.trees_of(boosting.node_table(spark, fitted.trees)) == fitted.trees
    empty = boosting.grow(halves[0].limit(0), SETTINGS, rounds=0)
    assert empty.rounds == 0 and empty.start == 0.0


def test_patience():
    assert boosting.best_round([3, 2, 2, 2, 1], 3) == (5, False)
    assert boosting.best_round([3, 2, 2, 2, 2, 1], 3) == (2, True)
    assert boosting.best_round([3, 2, 1], 2) == (3, False)
