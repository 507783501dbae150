"""Small random facts with holes, closed days and zero sales."""

from __future__ import annotations

import datetime as dt
import random

from shelfcast.sources.schemas import FACTS, FUTURE, STORES
from shelfcast.spec import PanelSpec

START = dt.date(2014, 1, 1)
SPEC = PanelSpec(
    valid_start=dt.date(2014, 11, 1), test_start=dt.date(2014, 12, 19), serve_to=dt.date(2015, 2, 4)
)


def fact_rows(stores=(1, 2, 10), days=400, seed=7, missing=0.1):
    """Store 2 also has a hole of 90 days; Sundays are closed; some open days sell nothing."""
    rng = random.Random(seed)
    rows = []
    for store in stores:
        for i in range(days):
            date = START + dt.timedelta(days=i)
            if rng.random() < missing or (store == 2 and 120 <= i < 210):
                continue
            weekday = date.isoweekday()
            is_open = int(weekday != 7)
            sales = rng.randint(1_000, 90_000) * store if is_open and rng.random() > 0.03 else 0
            promo = int(weekday <= 5 and (i // 7 + store) % 2 == 0)
            rows.append((store, weekday, date, sales, sales // 100, is_open, promo, "0", int(date.month == 7)))
    return rows


def facts(spark, **kwargs):
    return spark.createDataFrame(fact_rows(**kwargs), FACTS)


def stores(spark):
    return spark.createDataFrame(
        [
            (1, "a", "a", 500.0, 3, 2014, 1, 10, 2014, "Jan,Apr,Jul,Oct"),
            (2, "b", "c", None, None, None, 0, None, None, None),
            (10, "a", "b", 90.0, 12, 1990, 1, 1, 2013, "Feb,May,Aug,Nov"),
        ],
        STORES,
    )


def future(spark, stores=(1, 10), days=48):
    rows = []
    first = START + dt.timedelta(days=350)
    for store in stores:
        for i in range(days):
            date = first + dt.timedelta(days=i)
            is_open = None if i == 3 else int(date.isoweekday() != 7)
            rows.append((len(rows) + 1, store, date.isoweekday(), date, is_open, i % 2, "0", 0))
    return spark.createDataFrame(rows, FUTURE)
