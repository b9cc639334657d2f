"""Spanloom: offset-exact text-corpus audits as PySpark DataFrame jobs."""
