"""cuelattice: a PySpark-native analytics engine for time-aligned events, intervals and catalogs.

Subpackages: ``sources`` (ingest and publish), ``functions`` (column expressions), ``operators``
(DataFrame operators), ``plans`` (sequential grouped programs), ``streaming`` (Structured
Streaming wrappers), ``queries`` (registered queries with their SQL).
"""

__version__ = "0.1.0"
