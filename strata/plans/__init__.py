"""Whole queries over the given tables, each with SQL for the same rows."""
