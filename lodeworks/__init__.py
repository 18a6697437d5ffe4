"""A Spark-first engine for retrieval, knowledge graphs and corpus processing."""
