"""State, vector, customer and report operators: DataFrames in, DataFrames out."""
