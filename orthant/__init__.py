"""orthant: uncertain top-k dominance analytics and corpus operators on Spark DataFrames."""
