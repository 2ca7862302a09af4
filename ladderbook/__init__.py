"""Spark jobs that rebuild order books from captured market data."""
