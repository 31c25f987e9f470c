"""packlens: a Spark-first analytics engine for content-addressed storage and access traces."""
