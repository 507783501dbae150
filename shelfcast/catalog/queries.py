"""Every operator as a named query over the given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.catalog import fixtures as fx
from shelfcast.catalog.fixtures import SPEC
from shelfcast.functions.targets import closed_rule, from_log, money, to_log
from shelfcast.operators import baselines, calibration, checks, panel, profile, scores
from shelfcast.operators import history as hist
from shelfcast.operators import selection as sel
from shelfcast.operators import vocabulary as vocab
from shelfcast.plans import arma, boosting, classical, evaluation, model, runs, serving
from shelfcast.plans import features as feats
from shelfcast.plans import upkeep
from shelfcast.sources import files
from shelfcast.sources.files import extended_history
from shelfcast.sources.staging import stage_path

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

PANEL_COLUMNS = (
    "Store", "Date", "DayOfWeek", "Sales", "Open", "Promo", "StateHoliday", "SchoolHoliday", "is_gap",
    "StoreType", "Assortment",
)
WEEKS = (1, 2, 3, 4, 5, 6, 8, 12)
SEED_WEEKS = ("weeks_3", "weeks_4", "weeks_5", "weeks_6")
OTHER_WEEKS = ("weeks_1", "weeks_2", "weeks_8", "weeks_12")


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


#: Queries that are also registered on the panel of suppliers, which grows with the tables.
GROWING = (
    "panel_summary", "features_promo", "features_competition", "features_rolling", "features_dow", "missing_rates",
    "scores_all", "vocabulary", "encoded", "leakage_report", "serving_table", "request_status", "range_forecast",
)


def _by_supplier(fn: Query) -> Query:
    return lambda spark, sf_dir: fn(spark, fx.BySupplier(sf_dir))


def registered() -> dict[str, Query]:
    return _QUERIES | {f"supplier_{name}": _by_supplier(_QUERIES[name]) for name in GROWING}


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), n) for c, n in digits.items()})


# Files ------------------------------------------------------------------------------


def _as_csv(spark: SparkSession, df: DataFrame, name: str) -> str:
    path = stage_path(spark, name)
    df.write.option("header", True).csv(path)
    return path


@query
def facts_from_csv(spark, sf_dir):
    return files.read_facts(spark, _as_csv(spark, fx.daily(spark, sf_dir), "facts-csv"))


@query
def stores_from_csv(spark, sf_dir):
    return files.read_stores(spark, _as_csv(spark, fx.stores(spark, sf_dir), "stores-csv"))


@query
def future_from_csv(spark, sf_dir):
    return files.read_future(spark, _as_csv(spark, fx.future(spark, sf_dir), "future-csv"))


@query
def feature_file(spark, sf_dir):
    """Two columns of the feature file, which was built before the test window and then brought up to date."""
    path = stage_path(spark, "feature-file")
    facts, stores = fx.daily(spark, sf_dir), fx.stores(spark, sf_dir)
    upkeep.refreshed(spark, path, panel.before(facts, SPEC.test_start), stores, SPEC)
    table = upkeep.refreshed(spark, path, facts, stores, SPEC).select("split", "promo_count_14d")
    return table.groupBy("split", "promo_count_14d").agg(F.count(F.lit(1)).alias("rows"))


@query
def vocabulary_file(spark, sf_dir):
    path = stage_path(spark, "vocabulary-file")
    vocab.save_vocabulary(_vocabulary(spark, sf_dir), path)
    return vocab.load_vocabulary(spark, path)


@query
def serving_file(spark, sf_dir):
    path = stage_path(spark, "serving-file")
    files.write_serving_table(_serving(spark, sf_dir), path)
    table = spark.read.parquet(path).select("store_key", "Date", "Open", "Sales", "dow_ratio")
    return rounded(table, dow_ratio=6)


@query
def submission_file(spark, sf_dir):
    path = stage_path(spark, "submission-file")
    files.write_submission(_median_submission(spark, sf_dir), path)
    return spark.read.schema("Id long, Sales string").option("header", True).csv(path)


# Panel ------------------------------------------------------------------------------


@query
def panel_complete(spark, sf_dir):
    rows = panel.complete_panel(fx.daily(spark, sf_dir))
    return panel.with_stores(rows, fx.stores(spark, sf_dir)).select(*PANEL_COLUMNS)


@query
def panel_extended(spark, sf_dir):
    both = extended_history(fx.daily(spark, sf_dir), fx.future(spark, sf_dir))
    rows = panel.complete_extended_panel(both)
    return panel.with_stores(rows, fx.stores(spark, sf_dir)).select(*PANEL_COLUMNS)


@query
def history_with_future(spark, sf_dir):
    return extended_history(fx.daily(spark, sf_dir), fx.future(spark, sf_dir)).select(
        "Store", "DayOfWeek", "Date", "Sales", "Open", "Promo", "StateHoliday", "SchoolHoliday"
    )


@query
def panel_summary(spark, sf_dir):
    return panel.panel_summary(panel.add_split(panel.complete_panel(fx.daily(spark, sf_dir)), SPEC))


@query
def modelling_frame(spark, sf_dir):
    rows = panel.modelling_rows(panel.complete_panel(fx.daily(spark, sf_dir)))
    return panel.add_split(rows, SPEC).drop("is_gap")


@query
def split_windows(spark, sf_dir):
    return panel.proposed_split(fx.daily(spark, sf_dir), SPEC.horizon)


# Features ---------------------------------------------------------------------------


def _features(spark, sf_dir) -> DataFrame:
    return feats.build_features(fx.daily(spark, sf_dir), fx.stores(spark, sf_dir), SPEC)


@query
def features_calendar(spark, sf_dir):
    return _features(spark, sf_dir).select(
        "Store", "Date", "DayOfWeek", "day", "month", "year", "week_of_year", "day_of_year",
        "days_to_month_end", "is_month_start", "is_month_end", "split",
    )


@query
def features_promo(spark, sf_dir):
    return _features(spark, sf_dir).select(
        "Store", "Date", "promo_prev_day", "promo_next_day", "promo_first_day", "promo_last_day",
        "promo_lag7", "promo_lag14", "promo_count_14d",
    )


@query
def features_programme(spark, sf_dir):
    out = _features(spark, sf_dir).select(
        "Store", "Date", "promo2_active", "promo2_weeks_running", "promo2_restart_month"
    )
    return rounded(out, promo2_weeks_running=6)


@query
def features_competition(spark, sf_dir):
    out = _features(spark, sf_dir).select(
        "Store", "Date", "competition_distance_log", "competition_distance_missing",
        "competition_open_months",
    )
    return rounded(out, competition_distance_log=6, competition_open_months=6)


@query
def features_lags(spark, sf_dir):
    return _features(spark, sf_dir).select("Store", "Date", *[f"lag_{n}" for n in SPEC.lags])


@query
def features_rolling(spark, sf_dir):
    means = {f"roll_mean_{w}": 4 for w in SPEC.roll_windows}
    stds = {f"roll_std_{w}": 1 for w in SPEC.roll_windows}
    out = _features(spark, sf_dir).select("Store", "Date", *means, *stds, "trend_28_over_91")
    return rounded(out, **means, **stds, trend_28_over_91=6)


@query
def features_median_open(spark, sf_dir):
    out = _features(spark, sf_dir).select("Store", "Date", "roll_median_28", "open_rate_28")
    return rounded(out, roll_median_28=4, open_rate_28=6)


@query
def features_dow(spark, sf_dir):
    out = _features(spark, sf_dir).select("Store", "Date", "dow_mean_4", "dow_ratio")
    return rounded(out, dow_mean_4=4, dow_ratio=6)


@query
def features_bounded(spark, sf_dir):
    """Features of the test window from the part of the history they can read."""
    last = SPEC.test_start + dt.timedelta(days=SPEC.horizon - 1)
    out = feats.features_between(
        fx.daily(spark, sf_dir), fx.stores(spark, sf_dir), SPEC.test_start, last, SPEC
    ).select(
        "Store", "Date", "promo_next_day", "promo_count_14d", "lag_91", "roll_mean_91",
        "roll_median_28", "open_rate_28", "dow_mean_4", "competition_distance_log",
    )
    return rounded(
        out, roll_mean_91=4, roll_median_28=4, open_rate_28=6, dow_mean_4=4, competition_distance_log=6
    )


@query
def target_transform(spark, sf_dir):
    rows = fx.daily(spark, sf_dir)
    log = to_log(F.col("Sales"))
    back = closed_rule(from_log(log), F.col("Open"))
    out = rows.select("Store", "Date", log.alias("log_sales"), back.alias("sales_again"))
    return rounded(out, log_sales=6, sales_again=1)


@query
def missing_rates(spark, sf_dir):
    table = _features(spark, sf_dir)
    return rounded(sel.missing_rates(table, sel.feature_names(table, SPEC)), missing_pct=4)


# Baselines and scores ---------------------------------------------------------------


def _pred_rows(df: DataFrame) -> DataFrame:
    pred = F.round(closed_rule(F.col("pred"), F.col("Open")), 4)
    return df.select("Store", "Date", "Sales", "Open", pred.alias("pred"))


@query
def baseline_lag7(spark, sf_dir):
    facts = fx.daily(spark, sf_dir)
    rows = evaluation.window_rows(facts, "test", SPEC)
    return _pred_rows(baselines.same_day_last_week(rows, evaluation.week_before(facts, "test", SPEC)))


@query
def baseline_tiled(spark, sf_dir):
    facts = fx.daily(spark, sf_dir)
    rows = evaluation.window_rows(facts, "test", SPEC)
    return _pred_rows(baselines.last_week_repeated(rows, facts, SPEC.test_start))


@query
def baseline_median(spark, sf_dir):
    return _pred_rows(evaluation.median_forecasts(fx.daily(spark, sf_dir), "test", SPEC))


def _test_forecasts(spark, sf_dir) -> DataFrame:
    """The three baselines on the test window, one row per forecast."""
    rows = evaluation.baseline_forecasts(fx.daily(spark, sf_dir), "test", SPEC)
    return scores.long_forecasts(rows, {b: b for b in evaluation.BASELINES})


@query
def scores_all(spark, sf_dir):
    table = evaluation.baseline_scores(fx.daily(spark, sf_dir), SPEC)
    return rounded(table, rmse=4, mape=4, wape=4)


@query
def scores_without_calendar(spark, sf_dir):
    table = scores.evaluate(_test_forecasts(spark, sf_dir), is_open=None, scale=SPEC.money_scale)
    return rounded(table, rmse=4, mape=4, wape=4)


@query
def rmspe(spark, sf_dir):
    return rounded(scores.relative_error(_test_forecasts(spark, sf_dir)), rmspe=6)


@query
def calibration_ratio(spark, sf_dir):
    return rounded(calibration.total_ratio(_test_forecasts(spark, sf_dir)), ratio=6)


@query
def calibration_grid(spark, sf_dir):
    return rounded(calibration.multiplier_scores(_test_forecasts(spark, sf_dir)), rmspe=6)


@query
def best_multiplier(spark, sf_dir):
    table = calibration.best_multiplier(_test_forecasts(spark, sf_dir))
    return rounded(table, base_rmspe=6, best_rmspe=6, gain_pct=4, closed_form=6)


@query
def improvement(spark, sf_dir):
    table = evaluation.baseline_scores(fx.daily(spark, sf_dir), SPEC)
    table = scores.improvement(table, "lag7_rolling", ("split",)).drop("n_scored", *scores.METRICS)
    return rounded(table, **{f"improvement_{m}_pct": 4 for m in scores.METRICS})


@query
def headline(spark, sf_dir):
    table = scores.evaluate(_test_forecasts(spark, sf_dir), scale=SPEC.money_scale)
    table = scores.headline(table, model="lag7_rolling", baseline="weekday_median_4w")
    return rounded(table, baseline=4, model=4, drop_pct=4)


# Profiles ---------------------------------------------------------------------------


@query
def target_profile(spark, sf_dir):
    return rounded(profile.target_profile(fx.daily(spark, sf_dir)), value=3)


@query
def gap_audit(spark, sf_dir):
    table = profile.gap_audit(fx.daily(spark, sf_dir))
    return rounded(table, gapped_mean=4, gapped_std=4, gapped_p25=4, gapped_p50=4, gapped_p75=4)


@query
def dow_profile(spark, sf_dir):
    table = profile.weekday_profile(fx.daily(spark, sf_dir))
    return rounded(table, pct_open=4, mean_all=3, mean_open=3)


@query
def promo_effect(spark, sf_dir):
    return rounded(profile.promo_profile(fx.daily(spark, sf_dir)), mean=3, median=3)


@query
def promo_lift(spark, sf_dir):
    table = profile.promo_lift(fx.daily(spark, sf_dir), fx.stores(spark, sf_dir))
    return rounded(table, lift_pct=6)


@query
def store_heterogeneity(spark, sf_dir):
    return rounded(profile.store_heterogeneity(fx.daily(spark, sf_dir)), value=3)


@query
def metadata_profile(spark, sf_dir):
    table = profile.metadata_profile(fx.daily(spark, sf_dir), fx.stores(spark, sf_dir))
    return rounded(table, mean=3)


@query
def distance_profile(spark, sf_dir):
    return rounded(profile.distance_profile(fx.stores(spark, sf_dir)), value=3)


@query
def trend_monthly(spark, sf_dir):
    return rounded(profile.monthly_trend(fx.daily(spark, sf_dir)), mean=3)


@query
def trend_yearly(spark, sf_dir):
    return rounded(profile.yearly_trend(fx.daily(spark, sf_dir)), mean=3)


@query
def promo_cycle(spark, sf_dir):
    return rounded(hist.promo_agreement(fx.daily(spark, sf_dir), SPEC), agree_pct=6)


@query
def promo_mismatch_cost(spark, sf_dir):
    valid = panel.split_label(F.col("Date"), SPEC) == "valid"
    table = hist.promo_mismatch_cost(fx.daily(spark, sf_dir), valid, SPEC)
    return rounded(table, mean_error_pct=4)


@query
def holiday_rates(spark, sf_dir):
    table = profile.holiday_rates(panel.add_split(fx.daily(spark, sf_dir), SPEC))
    return rounded(table, school_holiday_rate=6, state_holiday_rate=6)


@query
def median_store(spark, sf_dir):
    return rounded(profile.median_store(fx.daily(spark, sf_dir)), mean=3)


@query
def stratified_sample(spark, sf_dir):
    return profile.stratified_sample(fx.daily(spark, sf_dir), 15, 0)


# Encoding ---------------------------------------------------------------------------


def _categories(spark, sf_dir) -> DataFrame:
    return panel.with_stores(fx.daily(spark, sf_dir), fx.stores(spark, sf_dir))


def _vocabulary(spark, sf_dir) -> DataFrame:
    return fx.shared(
        spark, sf_dir, "vocabulary", lambda: vocab.build_vocabulary(_categories(spark, sf_dir))
    )


def _future_vocabulary(spark, sf_dir) -> DataFrame:
    rows = panel.with_stores(fx.future(spark, sf_dir), fx.stores(spark, sf_dir))
    return fx.shared(spark, sf_dir, "future_vocabulary", lambda: vocab.build_vocabulary(rows))


@query
def vocabulary(spark, sf_dir):
    return _vocabulary(spark, sf_dir)


@query
def encoded(spark, sf_dir):
    coded = vocab.encode(_categories(spark, sf_dir), _vocabulary(spark, sf_dir))
    return coded.select("Store", "Date", *[f"{c}_code" for c in sel.CATEGORICAL])


@query
def encoded_with_unseen(spark, sf_dir):
    """History encoded by what the future calendar holds: absent stores have no code."""
    coded = vocab.encode(
        _categories(spark, sf_dir), _future_vocabulary(spark, sf_dir), strict=False
    )
    return coded.select("Store", "Date", *[f"{c}_code" for c in sel.CATEGORICAL])


@query
def vocabulary_outside(spark, sf_dir):
    return vocab.outside_vocabulary(_categories(spark, sf_dir), _future_vocabulary(spark, sf_dir))


@query
def vocabulary_difference(spark, sf_dir):
    return vocab.vocabulary_difference(
        _vocabulary(spark, sf_dir), _future_vocabulary(spark, sf_dir)
    )


# Checks -----------------------------------------------------------------------------


def _valid_rows():
    return panel.split_label(F.col("Date"), SPEC) == "valid"


def _valid_panel(spark, sf_dir) -> DataFrame:
    last = SPEC.test_start - dt.timedelta(days=1)
    return panel.complete_panel(
        fx.daily(spark, sf_dir), *panel.readable_days(SPEC.valid_start, last, SPEC)
    )


@query
def leakage_report(spark, sf_dir):
    valid = panel.split_days("valid", SPEC)
    table = checks.leakage_report(
        lambda rows: hist.add_history(rows, SPEC, promo=False, wanted=valid),
        panel.complete_panel(fx.daily(spark, sf_dir)),
        SPEC.valid_start,
        _valid_rows(),
        hist.sales_feature_names(SPEC),
    )
    return rounded(table, pct_differ=4)


@query
def leakage_report_planted(spark, sf_dir):
    """The same check on sales of a week ago, which do read the window."""
    table = checks.leakage_report(
        lambda rows: baselines.same_day_last_week(rows, rows, "week_ago"),
        panel.complete_panel(fx.daily(spark, sf_dir)),
        SPEC.valid_start,
        _valid_rows(),
        ["week_ago"],
    )
    return rounded(table, pct_differ=4)


@query
def leakage_report_planted_far(spark, sf_dir):
    """The same check on sales 60 days ahead, further than any lawful feature looks."""

    def build(rows: DataFrame) -> DataFrame:
        later = rows.select("Store", F.date_add("Date", -60).alias("Date"), F.col("Sales").cast("double").alias("ahead_60"))
        return rows.join(later, ["Store", "Date"], "left")

    table = checks.leakage_report(
        build, panel.complete_panel(fx.daily(spark, sf_dir)), SPEC.valid_start, _valid_rows(), ["ahead_60"]
    )
    return rounded(table, pct_differ=4)


@query
def feature_correlation(spark, sf_dir):
    rows = hist.add_history(_valid_panel(spark, sf_dir), SPEC, promo=False).where(_valid_rows())
    return rounded(checks.target_correlation(rows, hist.sales_feature_names(SPEC)), corr=6)


@query
def feature_correlation_max(spark, sf_dir):
    rows = hist.add_history(_valid_panel(spark, sf_dir), SPEC, promo=False).where(_valid_rows())
    table = checks.strongest(checks.target_correlation(rows, hist.sales_feature_names(SPEC)))
    return rounded(table, abs_corr=6)


SKEW_COLUMNS = (
    "promo_prev_day", "promo_next_day", "promo_count_14d", "promo2_weeks_running",
    "competition_distance_log", "lag_49", "roll_mean_28", "roll_median_28", "open_rate_28",
    "dow_mean_4",
)


def _two_paths(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    facts, stores = fx.daily(spark, sf_dir), fx.stores(spark, sf_dir)
    both = extended_history(facts, fx.future(spark, sf_dir))
    last = SPEC.test_start + dt.timedelta(days=SPEC.horizon - 1)
    offline = feats.features_between(facts, stores, SPEC.test_start, last, SPEC)
    return offline, feats.serving_features(both, stores, SPEC)


@query
def skew_report(spark, sf_dir):
    offline, served = _two_paths(spark, sf_dir)
    table = checks.skew_report(offline, served, list(SKEW_COLUMNS))
    return rounded(table, max_diff=5)


@query
def skew_report_where_they_lie(spark, sf_dir):
    """The serving table against its like from the training path, both bucketed by store and day."""
    served = _serving(spark, sf_dir)
    columns = [c for c in SKEW_COLUMNS if c in served.columns]
    offline = serving.offline_table(fx.daily(spark, sf_dir), fx.stores(spark, sf_dir), columns, SPEC)
    return rounded(checks.skew_report(offline, served, columns, key=list(serving.SERVED_BY)), max_diff=5)


@query
def skew_worst(spark, sf_dir):
    offline, served = _two_paths(spark, sf_dir)
    # Exact ratios, so that both engines order ties alike.
    table = checks.worst_disagreements(
        rounded(offline, open_rate_28=9), rounded(served, open_rate_28=9), "open_rate_28"
    )
    return rounded(table, offline=6, serving=6, diff=6)


# Runs -------------------------------------------------------------------------------


def _week_scores(spark, sf_dir) -> DataFrame:
    """Weekday medians over several numbers of weeks, scored on valid: one run each."""
    facts = fx.daily(spark, sf_dir)
    return evaluation.weeks_scores(facts, "valid", SPEC, WEEKS)


def _week_values(spark, sf_dir) -> DataFrame:
    return runs.run_values(*runs.runs_of_scores(_week_scores(spark, sf_dir)), "valid_mape")


@query
def run_values(spark, sf_dir):
    return rounded(_week_values(spark, sf_dir), value=4)


@query
def noise_floor(spark, sf_dir):
    table = runs.noise_floor(_week_values(spark, sf_dir), list(SEED_WEEKS))
    return rounded(table, mean=4, std=4, min=4, max=4, range=4)


@query
def variants_against_noise(spark, sf_dir):
    table = runs.against_noise(_week_values(spark, sf_dir), list(SEED_WEEKS), list(OTHER_WEEKS))
    return rounded(table, value=4)


@query
def ablation_table(spark, sf_dir):
    table = runs.ablation_table(_week_scores(spark, sf_dir), "weeks_1", "weeks_4")
    return rounded(
        table, rmse=4, mape=4, wape=4, mape_vs_full=4, improve_vs_baseline_pct=4
    )


# Serving ----------------------------------------------------------------------------


def _serving(spark, sf_dir) -> DataFrame:
    def build() -> DataFrame:
        facts = fx.daily(spark, sf_dir)
        names = sel.without(sel.feature_names(_features(spark, sf_dir), SPEC), ("lag_",))
        return serving.serving_table(
            facts,
            fx.future(spark, sf_dir),
            fx.stores(spark, sf_dir),
            names,
            SPEC,
            _vocabulary(spark, sf_dir),
        )

    return fx.shared(spark, sf_dir, "serving", build, staged=True)


def _requests(spark, sf_dir) -> DataFrame:
    """One request per order, for all stores; some for unknown stores, reversed or out of range."""
    n_stores = fx.stores(spark, sf_dir).agg(F.count(F.lit(1))).scalar()
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    start = F.date_add(F.lit(dt.date(2001, 9, 16)), (F.col("o_orderkey") % 97).cast("int"))
    return orders.select(
        F.col("o_orderkey").alias("request_id"),
        (F.col("o_custkey") % (n_stores + 2)).cast("int").alias("store_id"),
        start.alias("start_date"),
        F.date_add(start, (F.col("o_custkey") % 16 - 1).cast("int")).alias("end_date"),
    )


def _with_median(spark, sf_dir) -> Callable[[DataFrame], DataFrame]:
    facts = fx.daily(spark, sf_dir)

    def predict(rows: DataFrame) -> DataFrame:
        keyed = rows.withColumn("Store", F.col("store_key"))
        out = baselines.weekday_median(keyed, facts, SPEC.test_start)
        return out.withColumn("pred", closed_rule(F.col("pred"), F.col("Open")))

    return predict


@query
def serving_table(spark, sf_dir):
    table = _serving(spark, sf_dir).select(
        "store_key", "Date", "Open", "Promo", "Sales", "DayOfWeek", "StateHoliday", "SchoolHoliday",
        "StoreType", "promo_next_day", "promo_count_14d", "promo2_active", "roll_mean_28",
        "roll_median_28", "open_rate_28", "dow_mean_4",
    )
    return rounded(table, roll_mean_28=4, roll_median_28=4, open_rate_28=6, dow_mean_4=4)


@query
def serving_summary(spark, sf_dir):
    return serving.serving_summary(_serving(spark, sf_dir))


@query
def serving_ranges(spark, sf_dir):
    return serving.store_ranges(_serving(spark, sf_dir))


@query
def store_list(spark, sf_dir):
    return serving.store_list(_serving(spark, sf_dir), 10)


@query
def serving_missing(spark, sf_dir):
    table = _serving(spark, sf_dir)
    names = [c for c in table.columns if c not in ("store_key", "Date", "Open", "Sales")]
    return rounded(sel.missing_rates(table, names, above=0.05), missing_pct=4)


@query
def request_status(spark, sf_dir):
    return serving.request_status(_requests(spark, sf_dir), _serving(spark, sf_dir))


@query
def range_forecast(spark, sf_dir):
    days, _ = serving.forecast_ranges(
        _requests(spark, sf_dir), _serving(spark, sf_dir), _with_median(spark, sf_dir)
    )
    return days


@query
def range_summary(spark, sf_dir):
    _, totals = serving.forecast_ranges(
        _requests(spark, sf_dir), _serving(spark, sf_dir), _with_median(spark, sf_dir)
    )
    return totals


def _median_submission(spark, sf_dir) -> DataFrame:
    facts, future = fx.daily(spark, sf_dir), fx.future(spark, sf_dir)
    end = fx.HISTORY_END + dt.timedelta(days=1)
    rows = future.withColumn("Open", F.coalesce("Open", F.lit(1)))
    out = baselines.weekday_median(rows, facts, end)
    return out.select("Id", money(closed_rule(F.col("pred"), F.col("Open")), 0.975).alias("Sales"))


@query
def submission_baseline(spark, sf_dir):
    return _median_submission(spark, sf_dir)


@query
def submission_checks(spark, sf_dir):
    return checks.submission_report(_median_submission(spark, sf_dir), fx.future(spark, sf_dir))


@query
def submission_summary(spark, sf_dir):
    return rounded(model.submission_summary(_median_submission(spark, sf_dir)), mean=3, max=3)


@query
def store_forecast(spark, sf_dir):
    """Actual and two forecasts of the median-sized store on its trading days."""
    facts = fx.daily(spark, sf_dir)
    rows = evaluation.baseline_forecasts(facts, "test", SPEC)
    middle = profile.median_store(evaluation.window_rows(facts, "test", SPEC))
    table = evaluation.store_forecast(rows, middle, "weekday_median_4w", "last_week_tiled")
    return rounded(table, baseline=3, model=3, baseline_mape=4, model_mape=4)


# Classical --------------------------------------------------------------------------


@query
def interpolated_series(spark, sf_dir):
    known = panel.before(fx.daily(spark, sf_dir), SPEC.valid_start)
    series = classical.regular_series(known, SPEC).select("Store", "Date", "y")
    return rounded(series, y=6)


@query
def classical_forecast(spark, sf_dir):
    table = classical.forecast(fx.daily(spark, sf_dir), SPEC.valid_start, SPEC)
    return rounded(table.withColumn("pred", F.col("pred") / 100), pred=1)


@query
def classical_noise_coefficients(spark, sf_dir):
    """The model with moving-average terms, per store."""
    known = panel.before(fx.daily(spark, sf_dir), SPEC.valid_start)
    table = arma.coefficients(classical.regular_series(known, SPEC), SPEC)
    own = {name: F.get("own", F.lit(i)).alias(name) for i, name in enumerate(("f1", "f7", "g1", "g7"))}
    return rounded(table.select("Store", "n", "error", *own.values()), **dict.fromkeys(own, 5))


@query
def classical_noise_forecast(spark, sf_dir):
    table = arma.forecast(fx.daily(spark, sf_dir), SPEC.valid_start, SPEC)
    return rounded(table.withColumn("pred", F.col("pred") / 100), pred=1)


@query
def classical_scores(spark, sf_dir):
    """Classical and median forecasts on the stratified sample of stores."""
    facts = fx.daily(spark, sf_dir)
    sample = profile.stratified_sample(facts, 15, 0).select("Store")
    rows = evaluation.median_forecasts(facts, "valid", SPEC).withColumnRenamed("pred", "median")
    rows = rows.join(sample, "Store", "left_semi")
    forecasts = classical.forecast(facts, SPEC.valid_start, SPEC)
    rows = classical.classical_rows(rows, forecasts, "classical")
    long = scores.long_forecasts(rows, {"classical": "classical", "weekday_median_4w": "median"})
    return rounded(scores.evaluate(long, scale=SPEC.money_scale), rmse=3, mape=3, wape=3)


# Trees ------------------------------------------------------------------------------

#: Small trees that learn fast, so that patience ends growth after some tens of rounds.
SETTINGS = boosting.TreeSettings(patience=8, leaves=16, min_rows=20, learning_rate=0.2)
_fitted: dict[tuple[str, str], model.Fitted] = {}


def _feature_table(spark, sf_dir) -> DataFrame:
    return fx.shared(spark, sf_dir, "features", lambda: _features(spark, sf_dir).drop("Customers"))


def _chosen(spark, sf_dir) -> model.Fitted:
    """The chosen variant, fitted once per application and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _fitted:
        table = _feature_table(spark, sf_dir)
        names = sel.feature_names(table, SPEC)
        _fitted[key] = model.fit_variant(
            table, names, _vocabulary(spark, sf_dir), model.CHOSEN, SETTINGS
        )
    return _fitted[key]


def _median_scores(spark, sf_dir) -> DataFrame:
    table = evaluation.baseline_scores(fx.daily(spark, sf_dir), SPEC)
    return table.where(F.col("label") == "weekday_median_4w").withColumn("label", F.lit("baseline"))


@query
def training_rows(spark, sf_dir):
    """What the trees are grown on: trading days of train and valid with their label."""
    rows = panel.trading_days(panel.in_split(_feature_table(spark, sf_dir), "train", "valid"))
    out = rows.select("Store", "Date", "split", to_log(F.col("Sales")).alias("label"))
    return rounded(out, label=6)


@query
def store_levels(spark, sf_dir):
    """The number that stands for a store in the trees."""
    rows = panel.trading_days(panel.in_split(_feature_table(spark, sf_dir), "train"))
    return rounded(model.store_levels(rows, SETTINGS.level_smoothing), level=6)


@query
def store_levels_by_fold(spark, sf_dir):
    """The number that stands for a store in a training row, from the days outside the row's fold."""
    rows = panel.trading_days(panel.in_split(_feature_table(spark, sf_dir), "train"))
    levels = model.fold_levels(rows, SETTINGS.level_smoothing, SETTINGS.folds, SETTINGS.seed)
    return rounded(levels, level=6)


#: A small ensemble over weekday, promotion, day of the month and promotion days of two weeks.
FIXED_TREES = [
    {0: (0, None, [1.0, 2.0, 6.0], None), 1: (1, 0.5, None, None), 2: (None, None, None, 0.25),
     3: (None, None, None, -0.5), 4: (None, None, None, 1.125)},
    {0: (3, 4.5, None, None), 1: (2, 15.0, None, None), 2: (0, None, [5.0], None), 3: (None, None, None, 0.75),
     4: (None, None, None, -1.25), 5: (None, None, None, 2.0), 6: (None, None, None, 0.0625)},
    {0: (None, None, None, 3.0)},
]


@query
def tree_scores(spark, sf_dir):
    """A fixed ensemble, kept as a node table and read back, over every row of the feature table."""
    path = stage_path(spark, "nodes")
    boosting.node_table(spark, FIXED_TREES).write.parquet(path)
    ensemble = boosting.Ensemble(8.0, 0.1, boosting.trees_of(spark.read.parquet(path)), [])
    x = F.array(*[F.col(c).cast("double") for c in ("DayOfWeek", "Promo", "day", "promo_count_14d")])
    rows = _feature_table(spark, sf_dir).select("Store", "Date", ensemble.score(x).alias("score"))
    return rounded(rows, score=6)


@query
def gbt_scores(spark, sf_dir):
    """Model and baseline on both held-out windows, the baseline first."""
    table = model.holdout_scores(
        _chosen(spark, sf_dir), _feature_table(spark, sf_dir), _median_scores(spark, sf_dir), SPEC
    )
    return scores.in_label_order(table, ["baseline", "model"])


@query
def gbt_scored_days(spark, sf_dir):
    """What of the scores does not depend on the trees: days scored, and the baseline's errors."""
    table = gbt_scores(spark, sf_dir)
    own = {m: F.when(F.col("label") == "baseline", F.round(m, 4)) for m in scores.METRICS}
    return table.select("split", "label", "n_scored", *[c.alias(m) for m, c in own.items()])


@query
def gbt_headline(spark, sf_dir):
    """The model against the baseline on the test window."""
    table = gbt_scores(spark, sf_dir).where("split = 'test'")
    return scores.headline(table, model="model", baseline="baseline")


@query
def gbt_importance(spark, sf_dir):
    return _chosen(spark, sf_dir).importance(20)


@query
def gbt_importance_total(spark, sf_dir):
    """All shares of the gain: one for each feature, none negative, 100 in all."""
    return _chosen(spark, sf_dir).importance().agg(
        F.count(F.lit(1)).alias("n_features"),
        F.round(F.sum("gain_pct"), 6).alias("total_pct"),
        F.count_if(F.col("gain_pct") < 0).alias("negative"),
    )


def _experiments(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The tables of runs and metrics that all experiments were logged in, once per application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _logged:
        table = _feature_table(spark, sf_dir)
        baseline = _median_scores(spark, sf_dir).where(F.col("split") == "valid")
        root = stage_path(spark, "runs")
        names = sel.feature_names(table, SPEC)
        model.run_experiments(table, names, _vocabulary(spark, sf_dir), baseline, SPEC, SETTINGS, root)
        _logged[key] = root
    root = _logged[key]
    return runs.read_table(spark, root, "runs"), runs.read_table(spark, root, "run_metrics")


_logged: dict[tuple[str, str], str] = {}


@query
def gbt_variants(spark, sf_dir):
    """Every experiment, run and logged, then read back from the run tables."""
    return runs.run_values(*_experiments(spark, sf_dir), "valid_mape")


@query
def gbt_variant_rounds(spark, sf_dir):
    """Experiments and whether patience ended them: fewer rounds grown than the bound, the best before."""
    logged = _experiments(spark, sf_dir)
    best = runs.run_values(*logged, "best_round").select("name", F.col("value").alias("best"))
    grown = runs.run_values(*logged, "rounds_grown").select("name", F.col("value").alias("grown"))
    ended = (F.col("grown") < SETTINGS.rounds) & F.col("best").between(1, F.col("grown") - SETTINGS.patience)
    return best.join(grown, "name").select("name", ended.alias("ended_by_patience"))


@query
def gbt_noise_floor(spark, sf_dir):
    """How far the logged score moves between runs that differ in their seed."""
    return runs.noise_floor(gbt_variants(spark, sf_dir), model.SEED_RUNS)


@query
def gbt_against_noise(spark, sf_dir):
    others = [v for v in model.VARIANTS if v not in model.SEED_RUNS]
    return runs.against_noise(gbt_variants(spark, sf_dir), model.SEED_RUNS, others)


@query
def gbt_ablation(spark, sf_dir):
    """The logged scores of each experiment against the full one and the baseline."""
    table = runs.logged_scores(*_experiments(spark, sf_dir))
    base = _median_scores(spark, sf_dir).where(F.col("split") == "valid").select("label", *scores.METRICS)
    return runs.ablation_table(table.unionByName(base), "baseline")


@query
def gbt_refit_submission(spark, sf_dir):
    """Refit on all trading days at the chosen rounds; forecast the published ids."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}#refit")
    chosen = _chosen(spark, sf_dir)
    if key not in _fitted:
        table = _feature_table(spark, sf_dir)
        _fitted[key] = model.fit(
            table, chosen.design.features, _vocabulary(spark, sf_dir), SETTINGS, rounds=chosen.best_round
        )
    test = chosen.predict(panel.in_split(_feature_table(spark, sf_dir), "test")).withColumn("label", F.lit("model"))
    factor = calibration.best_multiplier(test).select("applied").first()["applied"]
    return model.submission(_fitted[key], fx.future(spark, sf_dir), _serving(spark, sf_dir), factor)


@query
def gbt_submission_days(spark, sf_dir):
    """Ids of the model's submission and whether nothing is sold."""
    return gbt_refit_submission(spark, sf_dir).select("Id", (F.col("Sales") == 0).alias("nothing_sold"))


@query
def gbt_published(spark, sf_dir):
    """Ids of the model's submission in the file that is written once its checks have passed."""
    path = stage_path(spark, "published")
    serving_rows = _serving(spark, sf_dir).where(F.isnull("Sales"))
    names = [c for c in _chosen(spark, sf_dir).design.features if c in serving_rows.columns]
    files.publish_submission(gbt_refit_submission(spark, sf_dir), fx.future(spark, sf_dir), serving_rows, names, path)
    return spark.read.schema("Id long, Sales double").option("header", True).csv(path).select("Id")


@query
def gbt_range_forecast(spark, sf_dir):
    """Every request answered by the model refitted on train and valid."""
    days, _ = serving.forecast_ranges(
        _requests(spark, sf_dir), _serving(spark, sf_dir), _served(spark, sf_dir).predict
    )
    return days


@query
def gbt_range_days(spark, sf_dir):
    """The days that the model's answers hold, and that nothing is forecast for closed ones."""
    days = gbt_range_forecast(spark, sf_dir)
    said = F.when(F.col("open"), F.col("predicted_sales") > 0).otherwise(F.col("predicted_sales") == 0)
    return days.select("request_id", "store_id", "date", "open", "promo", "actual_sales", said.alias("said"))


def _served(spark, sf_dir) -> model.Fitted:
    key = (spark.sparkContext.applicationId, f"{sf_dir}#served")
    if key not in _fitted:
        chosen = _chosen(spark, sf_dir)
        rows = panel.in_split(_feature_table(spark, sf_dir), "train", "valid")
        _fitted[key] = model.fit(
            rows, chosen.design.features, _vocabulary(spark, sf_dir), SETTINGS, rounds=chosen.best_round
        )
    return _fitted[key]


@query
def gbt_skew_report(spark, sf_dir):
    """The same model over the offline and the serving table, on the days both hold."""
    served = _served(spark, sf_dir)
    offline = served.predict(panel.in_split(_feature_table(spark, sf_dir), "test"))
    return checks.skew_report(offline, served.predict(_serving(spark, sf_dir)), ["pred"])


@query
def gbt_holdout_log(spark, sf_dir):
    """The held-out scores as a run, read back from the run tables."""
    root = stage_path(spark, "runs")
    chosen = _chosen(spark, sf_dir)
    params = vars(SETTINGS) | {"config": model.CHOSEN, "n_features": len(chosen.design.features), "best_round": chosen.best_round}
    runs.log_holdout(spark, root, gbt_scores(spark, sf_dir), params)
    logged = runs.read_table(spark, root, "runs"), runs.read_table(spark, root, "run_metrics")
    return runs.run_values(*logged, "test/model/improvement_mape_pct")


def _saved(spark, sf_dir) -> str:
    """Folder of the served model, written with the test scores of model and baseline."""
    path = stage_path(spark, "model")
    table = gbt_scores(spark, sf_dir).where("split = 'test'")
    through = SPEC.test_start - dt.timedelta(days=1)
    model.save_model(_served(spark, sf_dir), path, model.CHOSEN, through, table)
    return path


@query
def gbt_provenance(spark, sf_dir):
    """What the saved model says about itself, after it was written and read again."""
    return model.provenance(spark, _saved(spark, sf_dir), _serving(spark, sf_dir))


@query
def gbt_saved_model(spark, sf_dir):
    """Forecasts of the test window that the model gives otherwise after it was written and read again."""
    again = model.load_model(spark, _saved(spark, sf_dir))
    rows = panel.in_split(_feature_table(spark, sf_dir), "test")
    both = again.predict(_served(spark, sf_dir).predict(rows, "before"), "after")
    differs = ~F.col("before").eqNullSafe(F.col("after"))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(differs).alias("rows_differ"))


@query
def gbt_store_forecast(spark, sf_dir):
    """Actual, baseline and model of the median-sized store over the test window."""
    table = panel.in_split(_feature_table(spark, sf_dir), "test")
    rows = _chosen(spark, sf_dir).predict(table, "model")
    base = evaluation.median_forecasts(fx.daily(spark, sf_dir), "test", SPEC)
    rows = rows.join(base.select("Store", "Date", F.col("pred").alias("base")), ["Store", "Date"], "left")
    return evaluation.store_forecast(rows, profile.median_store(table), "base", "model")
