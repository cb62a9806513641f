"""gneiss: source-text quality analytics and corpus preparation on Spark DataFrames."""
