"""The feature table: calendar, promotion, programme, competitor and sales history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.dates import calendar_columns, iso_weekday
from shelfcast.functions.stores import competitor_columns, programme_columns, store_attributes
from shelfcast.operators.history import add_history
from shelfcast.operators.panel import (
    add_split,
    bounded_history,
    complete_extended_panel,
    readable_days,
    with_stores,
)
from shelfcast.spec import PanelSpec

HELPERS = ("competitor_since", "programme_since", "programme_months")


def build_features(
    rows: DataFrame, stores: DataFrame, spec: PanelSpec, panel_stores: DataFrame | None = None
) -> DataFrame:
    """All features of every row that is not a gap.

    ``rows`` may be the facts themselves or a date-complete panel: frames count days,
    not rows. ``panel_stores`` holds the stores of the whole panel when ``rows`` is
    only a part of it.
    """
    date = F.col("Date")
    attributes = store_attributes(stores, rows if panel_stores is None else panel_stores)
    out = add_history(rows, spec)
    if "is_gap" in rows.columns:
        out = out.where(~F.col("is_gap"))
    out = with_stores(out, attributes).withColumns(
        {
            "DayOfWeek": iso_weekday(date),
            **calendar_columns(date),
            **programme_columns(date),
            **competitor_columns(date),
        }
    )
    return add_split(out, spec).drop(*HELPERS)


def features_between(
    facts: DataFrame, stores: DataFrame, first: dt.date, last: dt.date, spec: PanelSpec
) -> DataFrame:
    """Features of the days ``first``..``last``, reading only the history they need."""
    part = bounded_history(facts, first, last, spec)
    wanted = F.col("Date").between(F.lit(first), F.lit(last))
    return build_features(part, stores, spec, panel_stores=facts).where(wanted)


def serving_features(history: DataFrame, stores: DataFrame, spec: PanelSpec) -> DataFrame:
    """Features of the servable days over history and published calendar."""
    first, last = spec.serve_from, spec.serve_to
    low, high = readable_days(first, last, spec)
    panel = complete_extended_panel(history, low, high)
    wanted = F.col("Date").between(F.lit(first), F.lit(last))
    return build_features(panel, stores, spec, panel_stores=history).where(wanted)
