"""tidemark: point-in-time company analytics as Spark DataFrame operators."""
