"""Two-stage text retrieval (retrieve, then rerank) as Spark DataFrame operators."""
