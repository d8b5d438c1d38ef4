"""arborframe: hierarchical classification analytics on Spark DataFrames."""
