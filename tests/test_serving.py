import datetime as dt

import data
import pytest
from pyspark.sql import functions as F

from shelfcast.functions.targets import closed_rule
from shelfcast.operators import checks, selection
from shelfcast.operators.vocabulary import build_vocabulary
from shelfcast.plans import boosting, model, serving
from shelfcast.plans.features import build_features
from shelfcast.sources.schemas import REQUESTS

SPEC = data.SPEC
SETTINGS = boosting.TreeSettings(rounds=4, leaves=8, min_rows=5, learning_rate=0.3)


def history(spark):
    """Sales known up to the last test day; the published calendar follows."""
    return data.facts(spark).where(F.col("Date") < F.lit(data.START + dt.timedelta(days=350)))


SERVED = data.PanelSpec(
    valid_start=dt.date(2014, 9, 1), test_start=dt.date(2014, 11, 1), serve_to=dt.date(2015, 2, 2)
)


@pytest.fixture(scope="module")
def table(spark):
    return build_features(history(spark), data.stores(spark), SERVED).drop("Customers").persist()


@pytest.fixture(scope="module")
def vocabulary(table):
    return build_vocabulary(table)


@pytest.fixture(scope="module")
def served(spark, table, vocabulary):
    names = selection.without(selection.feature_names(table), ("lag_",))
    return serving.serving_table(
        history(spark), data.future(spark), data.stores(spark), names, SERVED, vocabulary
    ).persist()


@pytest.fixture(scope="module")
def fitted(table, vocabulary):
    return model.fit_variant(table, selection.feature_names(table), vocabulary, "no_lags", SETTINGS)


def ask(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], REQUESTS)


def known(rows):
    return rows.withColumn("pred", closed_rule(F.lit(1000.0), F.col("Open")))


def test_serving_table_has_the_chosen_features(served, table):
    names = selection.without(selection.feature_names(table), ("lag_",))
    assert len(names) == 41 and len(selection.feature_names(table)) == 47
    assert served.columns[:6] == ["store_key", "Store", "Date", "Open", "Promo", "Sales"]
    assert set(names) <= set(served.columns) and len(served.columns) == len(set(served.columns))
    assert served.where("Store = 2 and Sales is null").isEmpty()
    summary = serving.serving_summary(served).first()
    assert summary["unseen"] == 96 and summary["rows"] == summary["known"] + 96


def test_bucketed_tables_are_joined_where_they_lie(spark, table, fitted):
    """No rows of serving, offline or calendar tables move for requests, skew report and submission."""
    names = selection.without(selection.feature_names(table), ("lag_",))
    served = serving.serving_table(history(spark), data.future(spark), data.stores(spark), names, SERVED)
    offline = serving.offline_table(history(spark), data.stores(spark), names, SERVED)
    calendar = serving.calendar_table(data.future(spark))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        skew = checks.skew_report(offline, served, ["roll_mean_28"], key=list(serving.SERVED_BY))
        requests = ask(spark, (1, dt.date(2014, 11, 3), dt.date(2014, 11, 9)))
        rows = serving.request_rows(requests, served).select("request_id", "store_key", "Date", "Promo")
        ids = model.submission(fitted, calendar, served)
        plans = plan(skew), plan(rows), plan(ids)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert skew.first()["rows_differ"] == 0 and skew.first()["rows"] > 100
    assert plans[0].count("SortMergeJoin") == 1 and "hashpartitioning" not in plans[0]
    join = plans[1][plans[1].index("SortMergeJoin") :]
    keyed = [x for x in join.splitlines() if "hashpartitioning(store_key" in x and "Date" in x]
    assert len(keyed) == 1, "the requested days move, the serving rows don't"
    assert not [x for x in plans[2].splitlines() if "hashpartitioning(store_key" in x and "Date" in x]
    assert ids.count() == 96


def test_status_of_each_kind_of_request(spark, served):
    d = dt.date
    requests = ask(
        spark,
        (1, d(2014, 11, 3), d(2014, 11, 9)),
        (1, d(2014, 12, 20), d(2014, 12, 26)),
        (1, d(2014, 11, 9), d(2014, 11, 3)),
        (1, d(2015, 1, 30), d(2015, 3, 1)),
        (9999, d(2014, 11, 9), d(2014, 11, 3)),
        (2, d(2014, 12, 20), d(2014, 12, 26)),
    )
    got = {r["request_id"]: r for r in serving.request_status(requests, served).collect()}
    assert [got[i]["status"] for i in range(6)] == [
        "ok", "ok", "reversed range", "outside range", "unknown store", "no rows",
    ]
    assert got[1]["n_days"] == 7 and got[5]["first_date"] >= SERVED.serve_from
    assert got[5]["last_date"] < d(2014, 12, 20)


def test_each_serving_row_is_forecast_once(spark, served):
    """The predictor is given the serving table and not the requested days."""
    seen = []

    def predict(rows):
        seen.append(set(rows.columns))
        return known(rows)

    requests = ask(spark, (1, dt.date(2014, 11, 3), dt.date(2014, 11, 16)))
    serving.forecast_ranges(requests, served, predict)
    assert seen == [set(served.columns)]


def test_days_nobody_asks_for_are_not_forecast(spark, served, tmp_path):
    served.write.parquet(str(tmp_path / "served"))
    table, seen = spark.read.parquet(str(tmp_path / "served")), []

    def predict(rows):
        seen.append(rows)
        return known(rows)

    d = dt.date
    requests = ask(spark, *[(1, d(2014, 11, 3), d(2014, 11, 9))] * 3, (2, d(2014, 11, 9), d(2014, 11, 3)), (10, d(2014, 11, 9), d(2014, 11, 10)))
    days, _ = serving.forecast_ranges(requests, table, predict)
    asked = "(Store = 1 and Date between '2014-11-03' and '2014-11-09') or (Store = 10 and Date between '2014-11-09' and '2014-11-10')"
    got = sorted(tuple(r) for r in seen[0].select("Store", "Date").collect())
    assert got == sorted(tuple(r) for r in table.where(asked).select("Store", "Date").collect())
    assert "LeftSemi" in seen[0]._jdf.queryExecution().executedPlan().toString()
    assert days.count() == 3 * table.where("Store = 1 and Date between '2014-11-03' and '2014-11-09'").count() + table.where(
        "Store = 10 and Date between '2014-11-09' and '2014-11-10'"
    ).count()


def test_a_faulty_submission_leaves_nothing(spark, served, tmp_path):
    from shelfcast.sources.files import publish_submission

    future = data.future(spark)
    good = future.select("Id", F.lit(2.5).alias("Sales"))
    rows = served.where("Sales is null")
    names = ["roll_mean_28", "promo_next_day"]
    bad = {
        "1 missing_ids": (good.where("Id <> 4"), rows),
        "1 repeated_ids": (good.union(good.where("Id = 7")), rows),
        "1 null_forecasts": (good.withColumn("Sales", F.when(F.col("Id") != 9, F.col("Sales"))), rows),
        "rows_without_features": (good, rows.withColumns({n: F.lit(None).cast("double") for n in names})),
    }
    for i, (message, (submission, features)) in enumerate(bad.items()):
        path = tmp_path / f"out{i}"
        with pytest.raises(ValueError, match=message):
            publish_submission(submission, future, features, names, str(path))
        assert not path.exists()
    publish_submission(good, future, rows, names, str(tmp_path / "good"))
    assert spark.read.option("header", True).csv(str(tmp_path / "good")).count() == 96


def test_range_forecasts(spark, served):
    requests = ask(spark, (1, dt.date(2014, 11, 3), dt.date(2014, 11, 16)), (10, dt.date(2014, 12, 20), dt.date(2014, 12, 26)))
    days, totals = serving.forecast_ranges(requests, served, known)
    by_request = {r["request_id"]: r for r in totals.collect()}
    unseen = by_request[1]
    assert unseen["n_days"] == 7 and unseen["mape_vs_actual"] is None
    assert unseen["total_predicted_sales"] == 1000.0 * unseen["n_trading_days"] > 0
    assert unseen["mean_predicted_sales_per_trading_day"] == 1000.0
    rows = days.where("request_id = 1").collect()
    assert all(r["actual_sales"] is None and r["absolute_percentage_error"] is None for r in rows)
    past = days.where("request_id = 0").collect()
    errors = [r["absolute_percentage_error"] for r in past if r["actual_sales"]]
    assert by_request[0]["mape_vs_actual"] == pytest.approx(sum(errors) / len(errors), abs=0.01)
    assert all(r["predicted_sales"] == 0 for r in past if not r["open"])


def test_ranges_do_not_pair_requests_with_whole_stores(spark, served, tmp_path):
    served.write.parquet(str(tmp_path / "served"))
    requests = ask(spark, *[(1, dt.date(2014, 11, 3), dt.date(2014, 11, 9))] * 50)
    rows = serving.request_rows(requests, spark.read.parquet(str(tmp_path / "served")))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    present = served.where("Store = 1 and Date between '2014-11-03' and '2014-11-09'").count()
    assert rows.count() == 50 * present


def test_store_list_and_ranges(served):
    listed = serving.store_list(served, 2).collect()
    assert [r["store_key"] for r in listed] == [1, 2] and listed[0]["n_stores"] == 3
    ranges = {r["store_key"]: r for r in serving.store_ranges(served).collect()}
    assert ranges[2]["last_date"] < ranges[1]["last_date"]


def test_model_scores_and_survives_saving(spark, tmp_path, table, fitted, served):
    assert 1 <= fitted.best_round <= 4
    assert not any(c.startswith("lag_") for c in fitted.design.columns)
    test = table.where("split = 'test'")
    rows = fitted.predict(test)
    assert rows.count() == test.count()
    assert rows.where("pred is null or pred < 0 or (Open = 0 and pred <> 0)").isEmpty()
    path = str(tmp_path / "model")
    scores = [("model", 1.0, 2.0, 3.0), ("baseline", 4.0, 5.0, 6.0)]
    scores = spark.createDataFrame(scores, "label string, rmse double, mape double, wape double")
    model.save_model(fitted, path, "no_lags", dt.date(2014, 10, 31), scores)
    again = model.load_model(spark, path).predict(test)
    key = ["Store", "Date", "pred"]
    assert rows.select(key).exceptAll(again.select(key)).isEmpty()
    about = model.provenance(spark, path, served).first()
    assert about["n_features"] == 41 and about["n_stores"] == 3 and about["config"] == "no_lags"
    assert about["metrics"]["model"]["mape"] == 2.0 and about["metrics"]["baseline"]["wape"] == 6.0


def test_unseen_store_gets_the_overall_level(table, fitted):
    other = table.where("split = 'test' and Store = 1").withColumn("Store", F.lit(77))
    rows = fitted.predict(other)
    assert rows.count() == other.count() and rows.where("pred is null").isEmpty()


def test_submission_has_all_ids(spark, fitted, served):
    out = model.submission(fitted, data.future(spark), served, 0.985)
    assert out.count() == 96 == out.select("Id").distinct().count()
    closed = data.future(spark).where("Open = 0").join(out, "Id")
    assert closed.where("Sales <> 0").isEmpty() and closed.count() > 0
    assert model.submission_summary(out).first()["zero_rows"] == closed.count()


def test_an_id_without_features_fails(spark, fitted, served):
    with pytest.raises(Exception, match="no features for id 5"):
        model.submission(fitted, data.future(spark), served.where("Date <> '2014-12-21'")).collect()


def test_experiments_are_logged(spark, tmp_path, table, vocabulary):
    from shelfcast.plans import evaluation, runs

    facts = history(spark)
    base = evaluation.baseline_scores(facts, SERVED, ("valid",)).where("label = 'weekday_median_4w'")
    names = selection.feature_names(table)
    root = str(tmp_path / "runs")
    quick = boosting.TreeSettings(rounds=2, leaves=4, min_rows=5)
    model.run_experiments(table, names, vocabulary, base, SERVED, quick, root, only=["full", "no_lags", "no_store"])
    logged = runs.read_table(spark, root, "runs"), runs.read_table(spark, root, "run_metrics")
    values = {r["name"]: r["value"] for r in runs.run_values(*logged, "valid_mape").collect()}
    assert set(values) == {"full", "no_lags", "no_store"} and all(v > 0 for v in values.values())
    params = runs.read_table(spark, root, "run_params").join(logged[0], "run_uuid")
    n = {r["name"]: r["value"] for r in params.where("key = 'n_features'").collect()}
    assert n == {"full": "47", "no_lags": "41", "no_store": "46"}
    used = runs.read_table(spark, root, "run_features").join(logged[0], "run_uuid")
    assert used.where("name = 'no_store' and feature = 'Store'").isEmpty()
