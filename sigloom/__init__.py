"""Equity-signal analytics as Spark table operators (DataFrame in, DataFrame out)."""
