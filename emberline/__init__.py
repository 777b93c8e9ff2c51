"""Security-log incident analytics expressed as PySpark DataFrame operators."""
