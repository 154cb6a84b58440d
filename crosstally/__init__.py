"""Analytics and learning from aggregated data, on Spark DataFrames."""
