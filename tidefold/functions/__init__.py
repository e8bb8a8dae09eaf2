"""Column functions: vectors, texts, numbers, and Arrow UDFs for what has no column form."""
