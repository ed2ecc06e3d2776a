"""Column expressions: keys, hashes, times, formats."""
