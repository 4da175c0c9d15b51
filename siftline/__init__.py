"""Spark-native curation, featurisation, scoring and evaluation of code corpora.

Every public operator takes DataFrames or Columns and returns DataFrames or
Columns; the work itself is planned and run by Spark.
"""

__version__ = "0.1.0"
