"""lodeline: a Spark-native engine for change-audit data.

Every public operator takes and returns DataFrames; nothing is executed until
the caller acts on the result.
"""

__version__ = "0.1.0"
