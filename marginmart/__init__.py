"""marginmart: year-over-year sales-margin analytics as Spark DataFrame queries."""

__version__ = "0.1.0"
