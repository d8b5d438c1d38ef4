"""Queries over the driver's tables and whole workflows."""
