"""rankspark: a Spark-first engine for ranking and preparing article collections."""
