"""sourcegrove: source-grounded retrieval and document analytics on Spark DataFrames."""
