"""Span analytics on Spark: DataFrame operators over notes, spans, lexicons, graphs and vectors."""

__version__ = "0.1.0"
