"""Text annotation, its evaluation and training-data preparation on Spark DataFrames."""
