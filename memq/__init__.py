"""memq: cross-examinable memory as PySpark DataFrame operators."""
