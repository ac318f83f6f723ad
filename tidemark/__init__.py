"""tidemark: change intelligence between periodic snapshots, on Spark DataFrames."""
