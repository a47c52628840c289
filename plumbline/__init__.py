"""plumbline: a PySpark-native engine for product-code capture data.

Subpackages: ``functions`` (Column expressions), ``operators`` (DataFrame
operators), ``sources`` (readers, fallbacks and sinks), ``streaming``
(Structured Streaming forms) and ``plans`` (the registered queries).
"""
