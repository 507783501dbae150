"""What keeps features and the leakage check fast on larger tables."""

import contextlib
import datetime as dt
import io

import data
import pytest
from compare import spark_rows

from pyspark.sql import functions as F

from shelfcast.operators import checks, history, panel


def _plan(df):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        df.explain(True)
    return said.getvalue().split("== Physical Plan ==")[0].split("== Optimized Logical Plan ==")[1]


@pytest.mark.parametrize("wanted", [(dt.date(2014, 11, 1), dt.date(2014, 12, 18)), (dt.date(2013, 12, 1), dt.date(2014, 1, 20))])
def test_history_of_some_days_is_that_of_all(spark, wanted):
    """Days within a chunk and, from 2013 on, days on both sides of a border between chunks."""
    spec = data.PanelSpec(valid_start=data.SPEC.valid_start, test_start=data.SPEC.test_start, serve_to=data.SPEC.serve_to, chunk_days=60)
    rows = panel.complete_panel(data.facts(spark))
    some = history.add_history(rows, spec, wanted=wanted)
    every = history.add_history(rows, spec).where(F.col("Date").between(*[F.lit(d) for d in wanted]))
    assert some.count() > 0
    assert spark_rows(some) == spark_rows(every)


def test_rolling_features_stay_out_of_whole_stage_code(spark):
    """As one method they would not be compiled; a lambda keeps them out, also without the median."""
    out = history.add_history(data.facts(spark), data.SPEC).select("Store", "Date", "roll_mean_7", "roll_std_91")
    assert "lambdafunction" in _plan(out)


def test_a_leak_is_found_whatever_the_numbers_of_stores_are(spark):
    """Negative, repeated and largest numbers; the panel is read once for both builds."""
    rows = panel.complete_panel(data.facts(spark, stores=(1, 2)))
    number = F.when(F.col("Store") == 1, F.lit(-7)).otherwise(F.lit(2**31 - 1))
    rows = rows.withColumn("Store", number)

    def build(df):
        return df.withColumn("own", F.col("Sales").cast("double")).withColumn("none", F.lit(1.0))

    valid = panel.split_label(F.col("Date"), data.SPEC) == "valid"
    report = {r["feature"]: r for r in checks.leakage_report(build, rows, data.SPEC.valid_start, valid, ["own", "none"]).collect()}
    judged = rows.where(valid)
    assert report["own"]["rows"] == report["none"]["rows"] == judged.count()
    assert report["own"]["rows_differ"] == judged.where("Sales IS NOT NULL").count()
    assert report["none"]["rows_differ"] == 0
