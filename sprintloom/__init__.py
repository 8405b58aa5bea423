"""Sprint-delivery analytics as PySpark DataFrame operators."""
