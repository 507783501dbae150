"""Every check passes on sound input and catches a planted fault."""

import data
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import checks, history, vocabulary
from shelfcast.operators.baselines import same_day_last_week
from shelfcast.operators.panel import complete_panel, split_label, with_stores
from shelfcast.sources.staging import stage


def _valid():
    return split_label(F.col("Date"), data.SPEC) == "valid"


def test_sales_features_do_not_leak(spark):
    report = checks.leakage_report(
        lambda rows: history.add_history(rows, data.SPEC),
        complete_panel(data.facts(spark)),
        data.SPEC.valid_start,
        _valid(),
        history.sales_feature_names(data.SPEC),
    ).collect()
    assert len(report) == 19
    assert all(r["rows_differ"] == 0 and r["rows"] == 3 * 48 for r in report)


def test_a_frame_one_day_too_new_is_caught(spark):
    from dataclasses import replace

    late = replace(data.SPEC, horizon=46)
    report = checks.leakage_report(
        lambda rows: history.add_history(rows, late),
        complete_panel(data.facts(spark)),
        data.SPEC.valid_start,
        _valid(),
        ["lag_49", "roll_mean_7"],
    )
    found = {r["feature"]: r["rows_differ"] for r in report.collect()}
    assert found["lag_49"] == 0 and found["roll_mean_7"] > 0


def test_last_week_leaks(spark):
    report = checks.leakage_report(
        lambda rows: same_day_last_week(rows, rows, "week_ago"),
        complete_panel(data.facts(spark)),
        data.SPEC.valid_start,
        _valid(),
        ["week_ago"],
    ).first()
    assert report["rows_differ"] > 0


def test_correlation_shows_the_target_itself(spark):
    rows = data.facts(spark).withColumn("copy", F.col("Sales") * 2).withColumn("noise", F.hash("Date"))
    strongest = checks.strongest(checks.target_correlation(rows, ["noise", "copy"])).first()
    assert strongest["feature"] == "copy" and strongest["abs_corr"] == pytest.approx(1.0)


def test_skew_is_zero_on_equal_paths_and_found_otherwise(spark):
    rows = data.facts(spark).select("Store", "Date", F.col("Sales").cast("double").alias("pred"))
    same = checks.skew_report(rows, rows, ["pred"]).first()
    assert same["rows_differ"] == 0 and same["max_diff"] == 0 and same["rows"] == rows.count()
    off = rows.withColumn("pred", F.when((F.col("Store") == 10), F.col("pred") + 5).otherwise(F.col("pred")))
    report = checks.skew_report(rows, off, ["pred"]).first()
    assert report["rows_differ"] == rows.where("Store = 10").count() and report["max_diff"] == 5
    worst = checks.worst_disagreements(rows, off, "pred").collect()
    assert len(worst) == 5 and {r["Store"] for r in worst} == {10}
    gone = rows.withColumn("pred", F.when(F.col("Store") != 1, F.col("pred")))
    assert checks.skew_report(rows, gone, ["pred"]).first()["rows_differ"] == rows.where("Store = 1").count()


def test_vocabulary_orders_numbers_as_numbers(spark):
    rows = spark.range(1, 13).select(
        F.col("id").cast("int").alias("Store"), F.concat(F.lit("t"), F.col("id") % 3).alias("StoreType")
    )
    found = vocabulary.build_vocabulary(rows, ("Store", "StoreType"))
    codes = {(r["column"], r["number"] or r["text"]): r["code"] for r in found.collect()}
    assert [codes["Store", n] for n in range(1, 13)] == list(range(12))
    assert [codes["StoreType", t] for t in ("t0", "t1", "t2")] == [0, 1, 2]


def test_vocabulary_differences_are_found(spark):
    rows = spark.range(1, 13).select(F.col("id").cast("int").alias("Store"))
    right = vocabulary.build_vocabulary(rows, ("Store",))
    wrong = vocabulary.build_vocabulary(rows.select(F.col("Store").cast("string")), ("Store",))
    assert vocabulary.vocabulary_difference(right, right).isEmpty()
    assert vocabulary.vocabulary_difference(right, wrong).count() == 24
    fewer = vocabulary.build_vocabulary(rows.where("Store <> 3"), ("Store",))
    assert vocabulary.vocabulary_difference(right, fewer).count() == 10 + 9


def test_encoding_refuses_unseen_values(spark, tmp_path):
    known = with_stores(data.facts(spark, stores=(1, 2)), data.stores(spark))
    vocab = vocabulary.build_vocabulary(known)
    vocabulary.save_vocabulary(vocab, str(tmp_path / "v"))
    vocab = vocabulary.load_vocabulary(spark, str(tmp_path / "v"))
    rows = with_stores(data.facts(spark), data.stores(spark))
    n = rows.where("Store = 10").count()
    with pytest.raises(ValueError, match=rf"{n} of 'Store'"):
        vocabulary.encode(rows, vocab)
    loose = vocabulary.encode(rows, vocab, strict=False)
    assert loose.where("Store_code is null").count() == n
    assert loose.count() == rows.count()
    assert vocabulary.encode(known, vocab).where("Store_code is null").isEmpty()


def test_submission_faults_are_counted(spark):
    expected = spark.range(1, 11).withColumnRenamed("id", "Id")
    good = expected.withColumn("Sales", F.lit(1.0))
    clean = checks.submission_report(good, expected).first().asDict()
    assert clean.pop("rows") == clean.pop("expected_rows") == 10 and not any(clean.values())
    bad = good.where("Id <> 4").union(spark.createDataFrame([(4000, None), (5, 2.0)], "Id long, Sales double"))
    found = checks.submission_report(bad, expected).first().asDict()
    assert found == {
        "rows": 11, "expected_rows": 10, "missing_ids": 1, "extra_ids": 1, "repeated_ids": 1, "null_forecasts": 1,
    }
    rows = spark.createDataFrame([(1, None, None), (2, 1, None)], "Id int, a int, b int")
    assert [r["Id"] for r in checks.rows_without_features(rows, ["a", "b"]).collect()] == [1]


def test_a_leak_far_ahead_is_caught(spark):
    def build(rows):
        later = rows.select("Store", F.date_add("Date", -60).alias("Date"), F.col("Sales").alias("ahead"))
        return rows.join(later, ["Store", "Date"], "left")

    early = data.SPEC.valid_start.replace(month=data.SPEC.valid_start.month - 2)
    rows = F.col("Date").between(F.lit(early), F.lit(data.SPEC.valid_start))
    report = checks.leakage_report(build, complete_panel(data.facts(spark)), data.SPEC.valid_start, rows, ["ahead"]).first()
    assert 0 < report["rows_differ"] <= report["rows"]


def test_small_domains_move_no_rows(spark):
    """Without automatic broadcasts, too, codes of weekdays and holidays need no exchange of the facts."""
    facts = data.facts(spark)
    words = stage(vocabulary.build_vocabulary(facts, ("DayOfWeek", "StateHoliday")), "words")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = vocabulary.add_codes(facts, words, ("DayOfWeek", "StateHoliday"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
