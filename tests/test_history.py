"""Window features against a direct calculation from a (store, date) dictionary."""

import datetime as dt
import math
import statistics
from dataclasses import replace

import data
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import history
from shelfcast.operators.panel import bounded_history, complete_panel
from shelfcast.plans.features import build_features, features_between


def brute(rows):
    """Features of each row by looking up single days."""
    sold = {(r[0], r[2]): r[3] for r in rows if r[5] == 1}
    opened = {(r[0], r[2]): r[5] for r in rows}
    promo = {(r[0], r[2]): r[6] for r in rows}
    out = {}
    for r in rows:
        store, date = r[0], r[2]

        def at(table, ago):
            return table.get((store, date - dt.timedelta(days=ago)))

        def span(table, newest, oldest):
            found = [at(table, k) for k in range(newest, oldest + 1)]
            return [v for v in found if v is not None]

        f = {f"lag_{n}": at(sold, n) for n in (49, 56, 63, 70, 77, 91)}
        for w in (7, 14, 28, 91):
            values = span(sold, 48, 47 + w)
            enough = len(values) >= max(2, w // 3)
            f[f"roll_mean_{w}"] = statistics.fmean(values) if enough else None
            f[f"roll_std_{w}"] = statistics.stdev(values) if enough else None
        values = span(sold, 48, 75)
        f["roll_median_28"] = statistics.median(values) if len(values) >= 9 else None
        values = span(opened, 48, 75)
        f["open_rate_28"] = statistics.fmean(values) if len(values) >= 9 else None
        values = [v for v in (at(sold, k) for k in (49, 56, 63, 70)) if v is not None]
        f["dow_mean_4"] = statistics.fmean(values) if len(values) >= 2 else None
        long, short = f["roll_mean_91"], f["roll_mean_28"]
        f["trend_28_over_91"] = short / long if short is not None and long else None
        f["dow_ratio"] = f["dow_mean_4"] / short if f["dow_mean_4"] is not None and short else None
        yesterday, tomorrow = at(promo, 1) or 0, at(promo, -1) or 0
        f["promo_prev_day"], f["promo_next_day"] = yesterday, tomorrow
        f["promo_first_day"] = int(r[6] == 1 and not yesterday)
        f["promo_last_day"] = int(r[6] == 1 and not tomorrow)
        f["promo_lag7"], f["promo_lag14"] = at(promo, 7) or 0, at(promo, 14) or 0
        f["promo_count_14d"] = sum(span(promo, 0, 13))
        out[store, date] = f
    return out


def assert_same(got, want):
    assert len(got) == len(want)
    for row in got:
        for name, value in want[row["Store"], row["Date"]].items():
            mine = row[name]
            if value is None:
                assert mine is None, (row["Store"], row["Date"], name, mine)
            else:
                assert mine is not None and math.isclose(mine, value, rel_tol=1e-9, abs_tol=1e-6), (
                    row["Store"], row["Date"], name, mine, value,
                )


@pytest.mark.parametrize("chunk", [9, 50, 728])
def test_features_equal_single_day_lookups(spark, chunk):
    rows = data.fact_rows(missing=0.3)
    facts = spark.createDataFrame(rows, data.FACTS)
    got = history.add_history(facts, replace(data.SPEC, chunk_days=chunk)).collect()
    assert_same(got, brute(rows))


def test_panel_and_facts_give_the_same_features(spark):
    facts, stores = data.facts(spark), data.stores(spark)
    direct = build_features(facts, stores, data.SPEC).drop("Customers")
    through_panel = build_features(complete_panel(facts), stores, data.SPEC).drop("Customers", "is_gap")
    columns = [c for c in direct.columns]
    keep = [F.round(c, 6).alias(c) if dict(direct.dtypes)[c] == "double" else F.col(c) for c in columns]
    a, b = direct.select(*keep), through_panel.select(*keep)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_bounded_history_gives_the_same_features(spark):
    facts, stores = data.facts(spark), data.stores(spark)
    first, last = dt.date(2014, 9, 10), dt.date(2014, 10, 2)
    wanted = F.col("Date").between(F.lit(first), F.lit(last))
    full = build_features(facts, stores, data.SPEC).where(wanted)
    part = features_between(facts, stores, first, last, data.SPEC)
    assert full.count() > 0
    assert full.exceptAll(part).isEmpty() and part.exceptAll(full).isEmpty()
    low = bounded_history(facts, first, last, data.SPEC).agg(F.min("Date")).first()[0]
    assert low >= first - dt.timedelta(days=138)


def test_a_series_is_spread_over_chunks(spark):
    """One store with all the rows still makes groups of bounded size."""
    facts = data.facts(spark, stores=(1,), days=400, missing=0.0)
    halo = history.with_halo(facts, 50, 138, 1)
    sizes = halo.groupBy("Store", history.CHUNK).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 50 + 138 + 1 and sizes[1] > 7
    assert halo.where(history.HOME).count() == facts.count()


@pytest.mark.parametrize("partitions", [4, 1000])
def test_one_exchange_for_all_windows(spark, tmp_path, partitions):
    data.facts(spark).write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        plan = history.add_history(facts, data.SPEC)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1


def test_a_bounded_build_prunes_the_scan(spark, tmp_path):
    data.facts(spark).write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    day = dt.date(2014, 10, 1)
    out = features_between(facts, data.stores(spark), day, day, data.SPEC).select("Store", "Date", "lag_49")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(Date,2014-05-16)" in plan and "LessThanOrEqual(Date,2014-10-02)" in plan
    assert "Customers" not in plan and "StateHoliday" not in plan


def test_sales_must_be_whole_numbers(spark):
    fractions = data.facts(spark).withColumn("Sales", F.col("Sales") / 3)
    with pytest.raises(TypeError, match="whole numbers"):
        history.add_history(fractions, data.SPEC)


def test_constant_sales_have_no_spread(spark):
    """Large equal sales: differences of running sums must not leave a remainder."""
    rows = [(1, 1, data.START + dt.timedelta(days=i), 99_999_999_999, 1, 1, 0, "0", 0) for i in range(200)]
    out = history.add_history(spark.createDataFrame(rows, data.FACTS), data.SPEC)
    worst = out.agg(*[F.max(f"roll_std_{w}") for w in (7, 14, 28, 91)]).first()
    assert all(v < 1e-7 * 99_999_999_999 for v in worst)


def test_promo_cycle_and_cost(spark):
    rows = data.fact_rows()
    by_day = {(r[0], r[2]): r for r in rows}
    got = {r["lag"]: r for r in history.promo_agreement(data.facts(spark), data.SPEC).collect()}
    for lag in (7, 14, 21, 28):
        pairs = [
            (r, by_day[r[0], r[2] - dt.timedelta(days=lag)])
            for r in rows
            if (r[0], r[2] - dt.timedelta(days=lag)) in by_day
        ]
        share = sum(a[6] == b[6] for a, b in pairs) / len(pairs) * 100
        assert got[lag]["pairs"] == len(pairs)
        assert math.isclose(got[lag]["agree_pct"], share)
    cost = history.promo_mismatch_cost(data.facts(spark), F.lit(True), data.SPEC).collect()
    errors = {True: [], False: []}
    for r in rows:
        then = by_day.get((r[0], r[2] - dt.timedelta(days=7)))
        if then and r[5] == 1 and r[3] > 0:
            errors[r[6] == then[6]].append(abs(r[3] - then[3]) / r[3] * 100)
    assert {c["promo_matches"]: c["rows"] for c in cost} == {k: len(v) for k, v in errors.items() if v}
    for c in cost:
        assert math.isclose(c["mean_error_pct"], statistics.fmean(errors[c["promo_matches"]]))
