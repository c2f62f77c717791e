"""Alerts over an ordered log of chain operations, as Spark jobs."""
