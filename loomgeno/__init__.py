"""Population-genotype analytics on Spark DataFrames."""
