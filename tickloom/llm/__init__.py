"""Operators for preparing language-model training corpora on Spark.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
only where the folder is present.
"""
