"""terrane: map generalisation of geological layers on Spark DataFrames."""
