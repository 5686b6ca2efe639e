"""A Spark-first analytics engine: ordered series, reducers, relations, streams and a small query language."""
