"""Target transform, closed-day rule and the error measures as aggregate expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_log(sales: Column) -> Column:
    return F.log1p(sales)


def from_log(value: Column) -> Column:
    """Back to sales, never negative."""
    return F.greatest(F.expm1(value), F.lit(0.0))


def closed_rule(pred: Column, is_open: Column) -> Column:
    """A closed store sells nothing; a missing prediction counts as nothing."""
    return F.when(is_open == 0, F.lit(0.0)).otherwise(F.coalesce(pred.cast("double"), F.lit(0.0)))


def money(pred: Column, multiplier: float = 1.0) -> Column:
    """A forecast times a multiplier, rounded half up to two decimals in decimal arithmetic."""
    exact = pred.cast("decimal(18,4)") * F.lit(Decimal(str(multiplier)))
    return F.round(exact, 2).cast("double")


def scored(actual: Column, is_open: Column | None) -> Column:
    """The rows a forecast is judged on: open days, or days with sales if that is all we know."""
    return actual > 0 if is_open is None else is_open == 1


def mean_where(value: Column, keep: Column) -> Column:
    return F.avg(F.when(keep, value))


def rmse(actual: Column, pred: Column, keep: Column, scale: int = 1) -> Column:
    error = (actual - pred) / F.lit(float(scale))
    return F.sqrt(mean_where(error * error, keep))


def mape(actual: Column, pred: Column, keep: Column) -> Column:
    """Percent; days without sales cannot be divided by and are left out."""
    return mean_where(F.abs(actual - pred) / F.when(actual > 0, actual), keep & (actual > 0)) * 100


def wape(actual: Column, pred: Column, keep: Column) -> Column:
    error = F.sum(F.when(keep, F.abs(actual - pred)))
    return F.try_divide(error, F.sum(F.when(keep, actual))) * 100


def rmspe(actual: Column, pred: Column, keep: Column | None = None) -> Column:
    """Root mean squared percentage error over days with sales; a fraction, not percent."""
    relative = (actual - pred) / F.when(actual > 0, actual)
    counted = actual > 0 if keep is None else keep & (actual > 0)
    return F.sqrt(mean_where(relative * relative, counted))
