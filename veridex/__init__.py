"""Relationship-authorization analytics on Spark."""
