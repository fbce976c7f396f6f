"""Event-log complexity analytics as PySpark DataFrame operators."""
