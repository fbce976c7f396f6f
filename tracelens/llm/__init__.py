"""Operators for preparing language-model training corpora on Spark.

Nothing else in the library imports this subpackage.
"""
