"""Which columns are features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.dates import calendar_columns
from shelfcast.functions.stores import competitor_columns, distance_columns, programme_columns
from shelfcast.operators.history import promo_edges, promo_windows, sales_feature_names
from shelfcast.spec import PanelSpec

# The inputs that are categories.
CATEGORICAL = ("Store", "StoreType", "Assortment", "StateHoliday", "DayOfWeek")
#: What is published for a day and used as it is.
PUBLISHED = ("Promo", "SchoolHoliday")
#: What a serving row is looked up by and shown with.
SERVING_KEYS = ("Store", "Date", "Open", "Promo", "Sales")


def declared_features(spec: PanelSpec) -> set[str]:
    """The model's inputs: categories, published flags and what the feature builders say they add."""
    date = F.col("Date")
    built = (
        calendar_columns(date), programme_columns(date), competitor_columns(date), distance_columns(F.lit(0.0)),
        promo_windows(), promo_edges(), sales_feature_names(spec),
    )
    return {*CATEGORICAL, *PUBLISHED}.union(*built)


def feature_names(df: DataFrame, spec: PanelSpec = PanelSpec()) -> list[str]:
    """The model's inputs among the columns, in their order."""
    declared = declared_features(spec)
    return [name for name in df.columns if name in declared]


def without(names: list[str], dropped: tuple[str, ...] | list[str]) -> list[str]:
    """``names`` less the dropped ones; a dropped name that ends in ``_`` is a prefix."""
    prefixes = tuple(d for d in dropped if d.endswith("_"))
    return [n for n in names if n not in dropped and not (prefixes and n.startswith(prefixes))]


def serving_columns(df: DataFrame, features: list[str]) -> DataFrame:
    """The serving keys, then those features that are not among them."""
    others = [F.col(name) for name in features if name not in SERVING_KEYS]
    return df.select(F.col("Store").cast("int").alias("store_key"), *SERVING_KEYS, *others)


def missing_rates(df: DataFrame, features: list[str], above: float = 0.0) -> DataFrame:
    """Percent of NULLs per feature, the most first, for features above a share."""
    rates = [
        F.struct(F.lit(f).alias("feature"), (F.avg(F.isnull(f).cast("int")) * 100).alias("missing_pct"))
        for f in features
    ]
    return (
        df.agg(F.array(*rates).alias("r"))
        .select(F.explode("r").alias("r"))
        .select("r.feature", "r.missing_pct")
        .where(F.col("missing_pct") > above * 100)
        .orderBy(F.desc("missing_pct"), "feature")
    )
