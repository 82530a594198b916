"""verisift: text provenance and consistency analytics on Spark DataFrames."""
