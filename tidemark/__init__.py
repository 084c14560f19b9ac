"""Point-in-time panel analytics for PySpark.

Operators take and return DataFrames.  ``functions`` holds column expressions,
``operators`` the relational building blocks, ``sources`` readers and sinks,
``streaming`` the Structured Streaming twins, and ``plans`` the named queries.
"""

__version__ = "0.1.0"
