import datetime as dt

import data
import pytest
from pyspark.sql import functions as F

from shelfcast.functions.dates import monday_of_week
from shelfcast.operators import panel
from shelfcast.sources import files
from shelfcast.sources.schemas import FACTS


def test_complete_panel_has_every_day_once(spark):
    facts = data.facts(spark)
    full = panel.complete_panel(facts)
    n_days = facts.agg(F.datediff(F.max("Date"), F.min("Date")) + 1).first()[0]
    assert full.count() == 3 * n_days == full.select("Store", "Date").distinct().count()
    gaps = full.where("is_gap")
    assert gaps.count() == 3 * n_days - facts.count()
    assert gaps.where("Open is not null or Promo is not null").isEmpty()
    assert full.where("StateHoliday is null or SchoolHoliday is null").isEmpty()
    assert full.where(F.col("DayOfWeek") != F.weekday("Date") + 1).isEmpty()


def test_panel_rows_come_from_many_tasks(spark):
    facts = data.facts(spark, stores=tuple(range(1, 41)), days=30)
    days = panel.store_days(facts).withColumn("p", F.spark_partition_id())
    assert days.select("p").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_extended_panel_tells_gaps_by_absence(spark):
    both = files.extended_history(
        data.facts(spark).where(F.col("Date") < "2014-12-17"), data.future(spark)
    )
    full = panel.complete_extended_panel(both)
    unseen = full.where("Date >= '2014-12-17'")
    assert unseen.where("Store = 2 and not is_gap").isEmpty()
    assert unseen.where("Store = 1").where("is_gap or Sales is not null").isEmpty()
    assert full.where("Open is null or Promo is null").isEmpty()
    assert full.where("is_gap and (Open = 1 or Promo = 1)").isEmpty()


def test_future_days_without_opening_count_as_open(spark):
    rows = files.future_rows(data.future(spark))
    assert rows.where("Open is null").isEmpty() and "Id" not in rows.columns
    assert data.future(spark).where("Open is null").count() == 2


def test_splits(spark):
    spec = data.SPEC
    labels = panel.add_split(data.facts(spark), spec).groupBy("split").agg(
        F.min("Date").alias("a"), F.max("Date").alias("b")
    )
    found = {r["split"]: r for r in labels.collect()}
    assert found["valid"]["a"] >= spec.valid_start and found["valid"]["b"] < spec.test_start
    assert found["test"]["a"] >= spec.test_start and found["train"]["b"] < spec.valid_start
    windows = {r["split"]: r for r in panel.proposed_split(data.facts(spark)).collect()}
    test, valid = windows["test"], windows["valid"]
    assert (test["last"] - test["first"]).days == 47
    assert (valid["last"] - valid["first"]).days == 47
    assert valid["last"] + dt.timedelta(days=1) == test["first"]


def test_csv_round_trip(spark, tmp_path):
    facts = data.facts(spark)
    facts.write.option("header", True).csv(str(tmp_path / "facts"))
    again = files.read_facts(spark, str(tmp_path / "facts"))
    assert again.schema == FACTS
    assert again.exceptAll(facts).isEmpty() and facts.exceptAll(again).isEmpty()
    data.stores(spark).write.option("header", True).csv(str(tmp_path / "stores"))
    assert files.read_stores(spark, str(tmp_path / "stores")).where("CompetitionDistance is null").count() == 1
    data.future(spark).write.option("header", True).csv(str(tmp_path / "future"))
    assert files.read_future(spark, str(tmp_path / "future")).where("Open is null").count() == 2



def test_submission_file_is_ordered_with_two_decimals(spark, tmp_path):
    rows = spark.createDataFrame([(3, 1.5), (1, 2.0), (2, 0.126)], "Id long, Sales double")
    files.write_submission(rows, str(tmp_path / "out"))
    lines = []
    for part in sorted((tmp_path / "out").glob("part-*.csv")):
        lines += part.read_text().split()[1:]
    assert lines == ["1,2.00", "2,0.13", "3,1.50"]


@pytest.mark.parametrize(
    "year, week, monday", [(2013, 1, "2013-01-07"), (2007, 1, "2007-01-01"), (2012, 1, "2012-01-02")]
)
def test_programme_start(spark, year, week, monday):
    found = spark.range(1).select(monday_of_week(F.lit(year), F.lit(week))).first()[0]
    assert str(found) == monday


def test_programme_start_equals_strptime(spark):
    pairs = [(y, w) for y in range(1999, 2017) for w in range(1, 53)]
    rows = spark.createDataFrame(pairs, "y int, w int")
    for r in rows.select("y", "w", monday_of_week(F.col("y"), F.col("w")).alias("d")).collect():
        assert r["d"] == dt.datetime.strptime(f"{r['y']}-{r['w']}-1", "%Y-%W-%w").date()
    assert rows.select(monday_of_week(F.col("y"), F.lit(0))).distinct().first()[0] is None
