"""Subject-predicate-object triples on Spark DataFrames."""
