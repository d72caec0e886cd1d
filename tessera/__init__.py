"""tessera: batch-stream analytics and corpus preparation, expressed as Spark DataFrames."""
