"""Analytics over versioned, hierarchical entity graphs, on Spark DataFrames."""
