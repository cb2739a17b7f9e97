"""Tabular preparation and model selection expressed as Spark DataFrame jobs."""

__version__ = "0.1.0"
