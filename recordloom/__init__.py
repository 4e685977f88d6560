"""Inventory, deduplication and organization of content-bearing records as Spark jobs."""
