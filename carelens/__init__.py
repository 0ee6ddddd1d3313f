"""carelens: care-quality analytics on Spark.

Cleans facility-level quality-measure extracts, builds a five-table star
schema (hospitals, measures, footnotes, performance_data,
performance_footnotes) and answers the reporting questions over it as
lazy DataFrames. Everything runs on built-in DataFrame / SQL operators.
"""

from carelens.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
