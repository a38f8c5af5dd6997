"""Search analytics on Spark: corpus, index, ranks, search and their upkeep, as DataFrames."""
