"""Time-series backtesting and bar analytics expressed as Spark DataFrame plans."""
