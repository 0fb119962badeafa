"""hanga — Spark-native analytics for labelled image collections.

Subpackages: ``sources`` (readers/writers), ``functions`` (column
expressions), ``operators`` (DataFrame -> DataFrame building blocks),
``plans`` (registered queries and their DuckDB oracles), ``streaming``
(incremental runs over a growing input folder).
"""

__version__ = "0.1.0"
