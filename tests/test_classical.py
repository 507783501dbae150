import datetime as dt
from dataclasses import replace

import data
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast.plans import classical

SPEC = replace(data.SPEC, chunk_days=10)
DAY = dt.date(2014, 1, 1)


def history(spark, values, store=1):
    rows = [(store, DAY + dt.timedelta(days=i), int(v)) for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "Store int, Date date, Sales long")


def test_gaps_are_filled_linearly_and_ends_extended(spark):
    logs = [None, 2, None, None, 8, None]
    rows = [(1, DAY + dt.timedelta(days=i), 0 if v is None else int(round(np.expm1(v) * 1e6))) for i, v in enumerate(logs)]
    facts = spark.createDataFrame(rows, "Store int, Date date, Sales long")
    got = classical.regular_series(facts.withColumn("Sales", F.col("Sales") / 1e6), SPEC).orderBy("Date")
    assert [round(r["y"], 4) for r in got.collect()] == [2, 2, 4, 6, 8, 8]


def test_series_equals_pandas_interpolation_over_chunks(spark):
    rng = np.random.default_rng(5)
    days = 120
    present = rng.random(days) > 0.4
    present[40:75] = False
    sales = np.where(rng.random(days) > 0.2, rng.integers(1, 5000, days), 0)
    facts = history(spark, [int(s) if p else None for s, p in zip(sales, present)])
    got = classical.regular_series(facts, SPEC).orderBy("Date").toPandas()
    dates = [DAY + dt.timedelta(days=int(i)) for i in np.flatnonzero(present)]
    want = pd.Series(sales[present].astype(float), index=pd.DatetimeIndex(dates)).asfreq("D")
    want = np.log1p(want.where(want != 0)).interpolate(limit_direction="both")
    assert got["Date"].tolist() == [d.date() for d in want.index]
    np.testing.assert_allclose(got["y"].to_numpy(), want.to_numpy(), rtol=1e-12)


def seasonal(n, a, b, s, seed=1):
    """A series whose weekly difference follows the model exactly."""
    rng = np.random.default_rng(seed)
    z = np.zeros(n)
    for t in range(9, n):
        z[t] = a * z[t - 1] + b * z[t - 2] + s * z[t - 7] - a * s * z[t - 8] - b * s * z[t - 9] + rng.normal(0, 0.05)
    y = np.full(n, 12.0)
    for t in range(7, n):
        y[t] = y[t - 7] + z[t]
    return y


def test_coefficients_are_recovered(spark):
    y = seasonal(1500, 0.5, -0.2, -0.3)
    series = spark.createDataFrame(
        [(1, DAY + dt.timedelta(days=i), float(v)) for i, v in enumerate(y)], "Store int, Date date, y double"
    )
    fitted = classical.fit(series, replace(SPEC, chunk_days=200)).first()
    assert fitted["error"] is None
    assert [fitted[c] for c in "abs"] == pytest.approx([0.5, -0.2, -0.3], abs=0.07)


def test_chunks_do_not_change_the_fit(spark):
    facts = data.facts(spark)
    cutoff = data.SPEC.valid_start
    a = classical.forecast(facts, cutoff, replace(SPEC, chunk_days=30)).orderBy("Store", "Date").toPandas()
    b = classical.forecast(facts, cutoff, replace(SPEC, chunk_days=5000)).orderBy("Store", "Date").toPandas()
    assert len(a) == 3 * 48
    np.testing.assert_allclose(a["pred"], b["pred"], rtol=1e-6)


def test_a_pure_weekly_pattern_is_repeated_or_refused(spark):
    week = [100, 200, 300, 400, 500, 600, 700]
    short = history(spark, (week * 3)[:18], store=2)
    noisy = history(spark, [w + (i * 7919) % 13 for i, w in enumerate(week * 30)], store=1)
    flat = history(spark, week * 30, store=3)
    facts = noisy.union(short).union(flat)
    got = classical.forecast(facts, dt.date(2016, 1, 1), SPEC).collect()
    errors = {r["Store"]: r["error"] for r in got if r["error"]}
    assert errors == {2: "too little history", 3: "no unique solution"}
    path = sorted((r["Date"], r["pred"]) for r in got if r["Store"] == 1)
    assert len(path) == 48 and path[0][0] == DAY + dt.timedelta(days=210)
    assert all(abs(p - week[i % 7]) < 30 for i, (_, p) in enumerate(path))


def test_missing_and_closed_days_are_zero(spark):
    facts = data.facts(spark)
    target = facts.where(F.col("Date") >= F.lit(data.SPEC.valid_start)).where("Date < '2014-12-19'")
    forecasts = classical.forecast(facts.where("Store <> 2"), data.SPEC.valid_start, SPEC)
    rows = classical.classical_rows(target, forecasts).collect()
    assert len(rows) == target.count()
    assert all(r["pred"] == 0 for r in rows if r["Open"] == 0 or r["Store"] == 2)
    assert all(r["pred"] > 0 for r in rows if r["Open"] == 1 and r["Store"] != 2)
