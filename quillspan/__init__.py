"""Spark-first key-value, text and link analytics.

Everything here declares DataFrame plans; Catalyst picks the physical strategy.
"""

__version__ = "0.1.0"
