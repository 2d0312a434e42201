"""arealcast: forecast verification over administrative areas, on Spark DataFrames."""
