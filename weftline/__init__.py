"""Lineage analytics for batch estates, as Spark jobs."""
