"""Panel and time-series econometrics on Spark DataFrames."""
