"""quire: corpus building, retrieval and evaluation as Spark DataFrame jobs.

Every public function takes and returns DataFrames (or Columns).  Models are
plugged in as batch functions (see :mod:`quire.operators.models`); the
deterministic stand-ins used by tests and the query registry are pure Spark
expressions so they stay inside whole-stage codegen.
"""

__all__ = ["session", "functions", "sources", "operators", "plans", "streaming"]
