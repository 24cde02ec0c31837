"""Spark-first analytics over industrial process telemetry.

Every operator is a function from DataFrames to a DataFrame.  Readings are kept
in long form ``(asset, scenario, ts, tag, value)``; the event tables (alerts,
sessions, recommendations, decisions, outcomes) are derived from them.
"""

__version__ = "0.1.0"
