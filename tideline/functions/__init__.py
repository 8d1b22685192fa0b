"""Column functions over vectors and forecasts."""
