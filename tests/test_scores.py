import datetime as dt
import math
import statistics

import data
import pytest
from pyspark.sql import functions as F

from shelfcast.functions.targets import money
from shelfcast.operators import baselines, calibration, scores
from shelfcast.plans import evaluation, runs
from shelfcast.sources.staging import stage

ROWS = [
    ("m", 100, 90.0, 1), ("m", 200, 260.0, 1), ("m", 0, 5.0, 1), ("m", 0, 0.0, 0), ("m", 400, 380.0, 1),
    ("b", 100, 50.0, 1), ("b", 200, 100.0, 1), ("b", 0, 50.0, 1), ("b", 0, 0.0, 0), ("b", 400, 500.0, 1),
]


def frame(spark):
    return spark.createDataFrame(ROWS, "label string, Sales long, pred double, Open int")


def test_measures(spark):
    got = {r["label"]: r for r in scores.evaluate(frame(spark)).collect()}["m"]
    errors = [10, -60, -5, 20]
    assert got["n_scored"] == 4
    assert got["rmse"] == pytest.approx(math.sqrt(statistics.fmean(e * e for e in errors)))
    assert got["mape"] == pytest.approx(statistics.fmean([10 / 100, 60 / 200, 20 / 400]) * 100)
    assert got["wape"] == pytest.approx(sum(map(abs, errors)) / 700 * 100)
    by_sales = {r["label"]: r for r in scores.evaluate(frame(spark), is_open=None).collect()}["m"]
    assert by_sales["n_scored"] == 3
    assert by_sales["rmse"] == pytest.approx(math.sqrt(statistics.fmean([100, 3600, 400])))


def test_improvement_and_headline(spark):
    table = scores.evaluate(frame(spark))
    gains = {r["label"]: r for r in scores.improvement(table, "b").collect()}
    values = {r["label"]: r for r in table.collect()}
    assert gains["b"]["improvement_mape_pct"] == 0
    assert gains["m"]["improvement_wape_pct"] == pytest.approx(
        (1 - values["m"]["wape"] / values["b"]["wape"]) * 100
    )
    head = {r["metric"]: r for r in scores.headline(table, "m", "b").collect()}
    assert head["rmse"]["model"] == values["m"]["rmse"]
    assert head["mape"]["drop_pct"] == pytest.approx(gains["m"]["improvement_mape_pct"])
    ordered = scores.in_label_order(table, ["b", "m"]).collect()
    assert [r["label"] for r in ordered] == ["b", "m"]


def test_multiplier_is_the_first_minimum_and_near_the_closed_form(spark):
    got = {r["label"]: r for r in calibration.best_multiplier(frame(spark)).collect()}["m"]
    ratios = [0.9, 1.3, 0.95]
    closed = statistics.fmean(ratios) / statistics.fmean(r * r for r in ratios)
    assert got["closed_form"] == pytest.approx(closed)
    grid = {r["multiplier"]: r["rmspe"] for r in calibration.multiplier_scores(frame(spark)).collect() if r["label"] == "m"}
    assert sorted(grid) == [round(0.96 + 0.005 * i, 3) for i in range(13)]
    assert got["best_multiplier"] == min(grid, key=lambda f: (grid[f], f))
    perfect = frame(spark).withColumn("pred", F.col("Sales").cast("double"))
    best = calibration.best_multiplier(perfect).first()
    assert best["best_multiplier"] == 1.0 and best["applied"] == 1.0


def test_baselines_on_a_small_history(spark):
    rows = data.fact_rows()
    facts, cutoff = data.facts(spark), data.SPEC.test_start
    target = facts.where(F.col("Date") >= F.lit(cutoff))
    medians = {}
    for r in rows:
        if r[5] == 1 and cutoff - dt.timedelta(days=28) <= r[2] < cutoff:
            medians.setdefault((r[0], r[1]), []).append(r[3])
    whole = {s: statistics.median(r[3] for r in rows if r[0] == s and r[5] == 1 and r[2] < cutoff) for s in (1, 2, 10)}
    for r in baselines.weekday_median(target, facts, cutoff).collect():
        want = medians.get((r["Store"], r["DayOfWeek"]))
        assert r["pred"] == (statistics.median(want) if want else whole[r["Store"]])
    by_day = {(r[0], r[2]): r[3] for r in rows}
    for r in baselines.same_day_last_week(target, facts).collect():
        assert r["pred"] == by_day.get((r["Store"], r["Date"] - dt.timedelta(days=7)))
    for r in baselines.last_week_repeated(target, facts, cutoff).collect():
        seen = [v for (s, d), v in by_day.items() if s == r["Store"] and d.isoweekday() == r["DayOfWeek"] and cutoff - dt.timedelta(days=7) <= d < cutoff]
        assert r["pred"] == (statistics.fmean(seen) if seen else None)


def test_no_forecast_before_the_cutoff_is_read(spark):
    facts, cutoff = data.facts(spark), data.SPEC.valid_start
    blind = facts.withColumn("Sales", F.when(F.col("Date") < F.lit(cutoff), F.col("Sales")))
    target = facts.where(F.col("Date") >= F.lit(cutoff))
    a = baselines.weekday_median(target, facts, cutoff).select("Store", "Date", "pred")
    b = baselines.weekday_median(target, blind, cutoff).select("Store", "Date", "pred")
    assert a.exceptAll(b).isEmpty()


def test_windows_and_the_week_before_reach_the_scan(spark):
    """Both sides of the lag-7 join read their own days only."""
    facts, spec = stage(data.facts(spark), "facts"), data.SPEC
    rows = evaluation.window_rows(facts, "valid", spec)
    lagged = baselines.same_day_last_week(rows, evaluation.week_before(facts, "valid", spec))
    plan = lagged._jdf.queryExecution().executedPlan().toString()
    pushed = [x for x in plan.splitlines() if "PushedFilters" in x]
    for first, last, x in (("2014-11-01", "2014-12-18", pushed[0]), ("2014-10-25", "2014-12-11", pushed[1])):
        assert f"GreaterThanOrEqual(Date,{first})" in x and f"LessThanOrEqual(Date,{last})" in x
    whole = baselines.same_day_last_week(rows, facts)
    assert lagged.exceptAll(whole).isEmpty() and whole.exceptAll(lagged).isEmpty()


def test_money_rounds_halves_up(spark):
    rows = spark.createDataFrame([(12127593.0,), (1.005,), (2.675,)], "p double")
    got = [r[0] for r in rows.select(money(F.col("p"), 0.975)).collect()]
    assert got == [11824403.18, 0.98, 2.61]


def test_noise_floor(spark):
    # One configuration under four seeds, and five other variants.
    seeds = {"full": 8.762, "seed_1": 8.757, "seed_2": 8.713, "seed_3": 8.846}
    others = {"no_dow_mean": 8.72, "no_store": 8.79, "lr_0.03_leaves_256": 8.82, "no_lags": 8.91, "lr_0.10_leaves_64": 8.94}
    rows = spark.createDataFrame(list({**seeds, **others}.items()), "name string, value double")
    floor = runs.noise_floor(rows, list(seeds)).first()
    assert [round(floor[c], 3) for c in ("mean", "std", "range")] == [8.77, 0.056, 0.133]
    flags = {r["name"]: r["inside_band"] for r in runs.against_noise(rows, list(seeds), list(others)).collect()}
    assert [n for n, inside in flags.items() if not inside] == ["no_lags", "lr_0.10_leaves_64"]


def test_run_tables(spark, tmp_path):
    root = str(tmp_path / "runs")
    first = runs.append_run(spark, root, "full", {"seed": 1}, {"valid_mape": 8.7}, {"why": "test"}, [("a", 60.0), ("b", 40.0)])
    runs.append_run(spark, root, "no_lags", metrics={"valid_mape": 8.9, "valid_rmse": 900})
    tables = runs.read_table(spark, root, "runs"), runs.read_table(spark, root, "run_metrics")
    values = {r["name"]: r["value"] for r in runs.run_values(*tables, "valid_mape").collect()}
    assert values == {"full": 8.7, "no_lags": 8.9}
    used = runs.read_table(spark, root, "run_features").where(F.col("run_uuid") == first).orderBy("position")
    assert [r["feature"] for r in used.collect()] == ["a", "b"]


def test_ablation_table(spark):
    facts = data.facts(spark)
    table = evaluation.weeks_scores(facts, "valid", data.SPEC, (2, 4))
    got = {r["name"]: r for r in runs.ablation_table(table, "weeks_2", "weeks_4").collect()}
    assert list(got) == ["weeks_4"] and got["weeks_4"]["mape_vs_full"] == 0
