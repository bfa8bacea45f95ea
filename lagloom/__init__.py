"""Signal analytics over long-format time series and text, built on Spark DataFrames."""
