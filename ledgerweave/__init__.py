"""Ledgerweave: a PySpark-native engine for transaction-network analytics.

Every operator is a function from DataFrames to a DataFrame.  Nothing here
starts a session on import; see :mod:`ledgerweave.session`.
"""

__version__ = "0.1.0"
