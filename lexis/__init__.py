"""lexis: a Spark-native text corpus and retrieval engine.

Every public function takes and returns DataFrames (or Columns); nothing is
materialised on the driver except bounded, size-checked parameters.
"""

__version__ = "0.1.0"
