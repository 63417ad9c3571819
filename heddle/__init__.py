"""heddle: curated-graph and corpus operators on Spark DataFrames."""
