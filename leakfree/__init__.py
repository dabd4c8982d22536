"""leakfree — leak-free cross-validation and experiment-log analytics as Spark DataFrame operators.

Sub-packages:
  sources/    readers and writers (tables, tolerant JSON-lines logs, file inventories, sinks)
  functions/  pure Column expressions (text caps, parsers, redaction, signatures, pricing)
  operators/  DataFrame operators (ordered scans, folds, features, models, metrics, log analytics)
  plans/      the registered queries over the provided tables and their SQL oracles
  streaming/  Structured Streaming twins of the batch log analytics
"""

from leakfree.session import checkpoint_dir, get_spark, materialize

__all__ = ["checkpoint_dir", "get_spark", "materialize"]
