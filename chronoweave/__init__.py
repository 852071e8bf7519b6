"""chronoweave: multi-channel time-series recordings analysed with Spark DataFrames."""
