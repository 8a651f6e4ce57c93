"""Text-corpus analytics as Spark DataFrame plans."""
