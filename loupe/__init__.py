"""loupe: curation and analysis of large media collections on Spark DataFrames."""
