"""Queries that run the engine's operators over the driver's tables, each with the same in SQL."""
