"""A Spark-first library for ranking and packing documents and for analysing change logs."""
