"""Operators over DataFrames: series and windows, text alignment, prototypes, metrics, the forecast model."""
