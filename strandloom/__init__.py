"""strandloom: interval, label-run, feature-hierarchy and evaluation analytics on Spark DataFrames."""
