"""dispatchlake: analysis of GPU dispatch-census captures on Spark DataFrames."""
