"""Spark-first analytics engine for versioned research corpora.

Sub-packages: ``sources`` (scans, list and connector parsers), ``functions`` (column expressions),
``operators`` (relational operators), ``streaming`` (stateful feeds), ``plans`` (registered queries).
"""

__version__ = "0.1.0"
