"""Moving-average terms: coefficients of simulated series, systems and forecasts against NumPy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.plans import arma
from shelfcast.sources.schemas import FACTS
from shelfcast.spec import PanelSpec

SPEC = PanelSpec(chunk_days=500)
START = dt.date(2000, 1, 1)


def simulated(f1, f7, g1, g7, n=6000, seed=0):
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.05, n)
    z = np.zeros(n)
    for t in range(7, n):
        z[t] = f1 * z[t - 1] + f7 * z[t - 7] + g1 * e[t - 1] + g7 * e[t - 7] + e[t]
    y = np.zeros(n)
    y[:7] = 5 + rng.normal(0, 0.2, 7)
    for t in range(7, n):
        y[t] = y[t - 7] + z[t]
    return y


# Weights whose own and noise parts do not cancel, so that each is told apart.
TRUE = {1: (0.5, 0.2, 0.3, 0.3), 2: (-0.4, 0.3, -0.3, 0.4), 3: (0.6, 0.3, 0.2, 0.3)}


@pytest.fixture(scope="module")
def series(spark):
    rows = [
        (s, START + dt.timedelta(days=i), float(v)) for s, c in TRUE.items() for i, v in enumerate(simulated(*c, seed=s))
    ]
    rows += [(9, START + dt.timedelta(days=i), 5.0 + i % 3) for i in range(40)]
    return spark.createDataFrame(rows, "Store int, Date date, y double").repartition(4).cache()


def test_coefficients_are_recovered(series):
    found = {r["Store"]: r for r in arma.coefficients(series, SPEC).collect()}
    for store, true in TRUE.items():
        assert found[store]["error"] is None
        assert found[store]["own"] == pytest.approx(true, abs=0.12)
    assert found[9]["error"] == "too little history"


def test_both_stages_against_least_squares(series):
    """The sums of the second stage are those of the residuals themselves."""
    y = np.array([r["y"] for r in series.where("Store = 3").orderBy("Date").collect()])
    z = np.full(len(y), np.nan)
    z[7:] = y[7:] - y[:-7]
    back = lambda x, k: np.concatenate([np.full(k, np.nan), x[: len(x) - k]])
    rows = ~np.isnan(np.stack([back(z, k) for k in arma.LAGS])).any(0)
    long = np.linalg.lstsq(np.stack([back(z, k)[rows] for k in arma.LONG], 1), z[rows], rcond=None)[0]
    e = z - sum(w * back(z, k) for w, k in zip(long, arma.LONG, strict=True))
    x = np.stack([back(z, k)[rows] for k in arma.OWN] + [back(e, k)[rows] for k in arma.NOISE], 1)
    own = np.linalg.lstsq(x, z[rows], rcond=None)[0]
    found = arma.coefficients(series, SPEC).where("Store = 3").first()
    assert found["n"] == rows.sum()
    assert found["long"] == pytest.approx(long, abs=1e-7) and found["own"] == pytest.approx(own, abs=1e-7)


def test_a_system_without_one_solution_has_nulls(spark):
    number = lambda rows: [[F.lit(float(x)) for x in row] for row in rows]
    one = spark.range(1)
    assert one.select(arma.solution(number([[2, 1, 5], [1, 3, 10]]))).first()[0] == pytest.approx([1, 3])
    assert None in one.select(arma.solution(number([[1, 2, 3], [2, 4, 6]]))).first()[0]


def test_forecast_follows_the_model(spark, series):
    import math

    rows, days = [], 900
    for store in TRUE:
        for i, v in enumerate(simulated(*TRUE[store], n=days, seed=store)):
            date = START + dt.timedelta(days=i)
            rows.append((store, date.isoweekday(), date, round(math.expm1(v + 5)), 1, 1, 0, "0", 0))
    rows += [(7, 1, START + dt.timedelta(days=i), 100 + i, 1, 1, 0, "0", 0) for i in range(30)]
    facts = spark.createDataFrame(rows, FACTS)
    cutoff = START + dt.timedelta(days=days)
    found = arma.forecast(facts, cutoff, SPEC)
    assert found.where("error is null").groupBy("Store").count().collect() and found.where("Store = 7").first()["error"] == "too little history"
    got = {(r["Store"], r["Date"]): r["pred"] for r in found.where("error is null").collect()}
    assert len(got) == 3 * SPEC.horizon and all(v > 0 for v in got.values())
    known = {r["Store"]: r for r in arma.coefficients(arma.regular_series(facts, SPEC), SPEC).collect()}
    y = np.log1p([r[3] for r in rows if r[0] == 3])
    z = np.concatenate([np.full(7, np.nan), y[7:] - y[:-7]])
    e = z.copy()
    for w, k in zip(known[3]["long"], arma.LONG, strict=True):
        e -= w * np.concatenate([np.full(k, np.nan), z[:-k]])
    y, z, e, own = list(y), list(z), list(e), known[3]["own"]
    for i in range(SPEC.horizon):
        z.append(own[0] * z[-1] + own[1] * z[-7] + own[2] * e[-1] + own[3] * e[-7])
        e.append(0.0)
        y.append(y[-7] + z[-1])
        assert got[3, cutoff + dt.timedelta(days=i)] == pytest.approx(math.expm1(y[-1]), rel=1e-6)
