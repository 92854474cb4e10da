"""Spark-first engine for multi-sheet spatial matching and assembly."""
