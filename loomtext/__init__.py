"""Text-similarity, retrieval and corpus analytics as PySpark plans."""
