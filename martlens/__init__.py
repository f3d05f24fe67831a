"""Retail market signals as Spark jobs."""
