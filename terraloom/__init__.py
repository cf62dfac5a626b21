"""Data quality, vocabulary normalisation, mesh audit and lineage on PySpark.

Every public function takes and returns DataFrames (or Columns); the only values that
reach the driver are bounded statistics, one row per column or per octree level.
"""

__version__ = "0.1.0"
