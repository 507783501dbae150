"""Retail demand forecasting on Spark: panels, horizon-safe features, scores, forecasts."""

from shelfcast.spec import PanelSpec

__all__ = ["PanelSpec"]
