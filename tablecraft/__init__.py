"""Table curation, profiling, feature engineering and model comparison on Spark DataFrames."""
