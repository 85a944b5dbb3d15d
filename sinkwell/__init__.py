"""Source-to-sink analytics as Spark DataFrames."""
