"""Punctuality and market-structure analytics on Spark."""
