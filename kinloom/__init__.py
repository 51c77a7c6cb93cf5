"""Record linkage and household matching on Spark DataFrames."""
