"""palimpsest: text-reuse detection as Spark DataFrame operators.

Subpackages: ``functions`` (Column expressions), ``operators`` (DataFrame
operators), ``sources`` (readers, table adapter, sinks), ``plans``
(composite modes and jobs), ``streaming`` (micro-batch detection).
"""

__version__ = "0.1.0"
