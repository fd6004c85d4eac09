"""Vector analytics on Spark: exact and approximate nearest-neighbour search over DataFrames."""
