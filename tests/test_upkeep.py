"""A feature table that was refreshed equals one that was built at once, and reads and writes less."""

import datetime as dt
from dataclasses import replace

import data
import pytest
from pyspark.sql import functions as F

from shelfcast.plans import upkeep
from shelfcast.plans.features import build_features

SPEC = data.SPEC


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("facts") / "daily")
    data.facts(spark).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def built(monkeypatch):
    """Spans that were built, and the plans that built them."""
    seen, build = [], upkeep.features_between

    def watched(facts, stores, first, last, spec):
        out = build(facts, stores, first, last, spec)
        seen.append((first, last, out._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(upkeep, "features_between", watched)
    return seen


def same(table, facts, stores, spec=SPEC):
    want = build_features(facts, stores, spec).drop("Customers")
    assert set(table.columns) == set(want.columns) and table.count() == want.count()
    numbers = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in want.dtypes]
    assert table.select(*numbers).exceptAll(want.select(*numbers)).isEmpty()


def test_appended_days_are_swapped_in(spark, facts, tmp_path, built):
    path, stores = str(tmp_path / "t"), data.stores(spark)
    cut = dt.date(2014, 12, 10)
    early = facts.where(F.col("Date") < F.lit(cut))
    same(upkeep.refreshed(spark, path, early, stores, SPEC), early, stores)
    table = upkeep.refreshed(spark, path, facts, stores, SPEC)
    same(table, facts, stores)
    pruned = table.where("split = 'test'").select("Sales")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in pruned
    first, last, plan = built[1]
    assert first == dt.date(2014, 12, 1) and len(built) == 2
    # The days before the look-back of the first month are not read.
    low = first - dt.timedelta(days=SPEC.look_back)
    assert f"GreaterThanOrEqual(Date,{low})" in plan.replace(" ", "")
    upkeep.refreshed(spark, path, facts, stores, SPEC)
    assert len(built) == 2, "nothing changed, nothing is built"


def test_a_changed_day_reaches_as_far_as_frames_do(spark, facts, tmp_path, built):
    path, stores = str(tmp_path / "t"), data.stores(spark)
    upkeep.refreshed(spark, path, facts, stores, SPEC)
    day = facts.where("Open = 1").agg(F.min("Date")).first()[0] + dt.timedelta(days=160)
    changed = facts.withColumn("Sales", F.when(F.col("Date") == F.lit(day), F.col("Sales") + 5).otherwise(F.col("Sales")))
    same(upkeep.refreshed(spark, path, changed, stores, SPEC), changed, stores)
    assert built[1][0] <= day - dt.timedelta(days=1) and built[1][1] >= day + dt.timedelta(days=SPEC.look_back)
    assert built[1][0] > built[0][0]


@pytest.mark.parametrize("what", ["stores", "settings", "lost day"])
def test_other_changes_build_all(spark, facts, tmp_path, built, what):
    path, stores, spec, rows = str(tmp_path / "t"), data.stores(spark), SPEC, facts
    upkeep.refreshed(spark, path, rows, stores, spec)
    if what == "stores":
        stores = stores.withColumn("CompetitionDistance", F.col("CompetitionDistance") * 2)
    elif what == "settings":
        spec = replace(SPEC, test_start=SPEC.test_start + dt.timedelta(days=3))
    else:
        rows = rows.where(F.col("Date") != F.lit(rows.agg(F.max("Date")).first()[0]))
    same(upkeep.refreshed(spark, path, rows, stores, spec), rows, stores, spec)
    assert built[1][0] == built[0][0]


def test_a_refresh_that_was_cut_short_is_done_again(spark, facts, tmp_path, built, monkeypatch):
    path, stores = str(tmp_path / "t"), data.stores(spark)
    early = facts.where(F.col("Date") < F.lit(dt.date(2014, 12, 10)))
    upkeep.refreshed(spark, path, early, stores, SPEC)

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(upkeep, "features_between", lost)
        with pytest.raises(OSError, match="lost"):
            upkeep.refreshed(spark, path, facts, stores, SPEC)
    same(upkeep.refreshed(spark, path, facts, stores, SPEC), facts, stores)
