"""Document, claims and corpus analytics written as PySpark DataFrame operators."""
