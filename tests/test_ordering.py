import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators.ordering import exact_quantiles, running_totals
from shelfcast.operators.profile import stratified_sample

P = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}


def test_running_totals(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), (F.col("id") % 5).alias("w"))
    got = running_totals(rows, ["k"], F.col("w"), "total").orderBy("k").collect()
    want = np.cumsum([r["w"] for r in rows.orderBy("k").collect()])
    assert [r["total"] for r in got] == want.tolist()


@pytest.mark.parametrize("n", [1, 2, 3, 1000])
def test_quantiles_of_all_rows(spark, n):
    values = (np.random.default_rng(n).integers(0, 50, n) ** 3).tolist()
    df = spark.createDataFrame([(int(v),) for v in values], "v long")
    got = exact_quantiles(df, "v", P).first()
    for name, p in P.items():
        assert got[name] == pytest.approx(np.quantile(values, p))


def test_quantiles_with_one_value_on_a_third_of_the_rows(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", 42.0)] * 1000 + [("hot", float(v)) for v in rng.normal(40, 9, 1500)]
    rows += [("cold", float(v)) for v in rng.normal(0, 1, 500)] + [("cold", None)]
    got = exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", P, ["g"]).collect()
    for r in got:
        values = [v for g, v in rows if g == r["g"] and v is not None]
        for name, p in P.items():
            assert r[name] == pytest.approx(np.quantile(values, p))


@pytest.mark.parametrize("stores", [15, 17, 31])
def test_strata_are_as_equal_as_can_be(spark, stores):
    facts = spark.range(stores).select(
        F.col("id").cast("int").alias("Store"), F.lit(1).alias("Open"), ((F.col("id") * 37) % 101).alias("Sales")
    )
    got = sorted(stratified_sample(facts, 15).collect(), key=lambda r: r["stratum"])
    order = [r["Store"] for r in facts.orderBy("Sales", "Store").collect()]
    parts = np.array_split(order, 15)
    assert [r["stores"] for r in got] == [len(p) for p in parts]
    assert all(r["Store"] in p.tolist() for r, p in zip(got, parts))
