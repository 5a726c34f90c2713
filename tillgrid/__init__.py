"""tillgrid — retail sales analytics as Spark DataFrame plans.

Subpackages: ``sources`` (scans and sinks), ``functions`` (Column
expressions), ``operators`` (DataFrame -> DataFrame operators), ``plans``
(composite reports), ``streaming`` (Structured Streaming jobs).
"""

__version__ = "0.1.0"
