"""Spark-first analytics for news-and-price time series: sources, windows, prototypes, metrics, scoring."""
