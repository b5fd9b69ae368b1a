"""evalloop: the data side of an evaluate -> mine -> augment loop, as Spark jobs.

Every public function takes and returns DataFrames (or Columns for the
per-row text rules in :mod:`evalloop.functions.text`).
"""

__version__ = "0.1.0"
