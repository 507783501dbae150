"""Compositions of operators: feature tables, models, forecasts, serving."""
