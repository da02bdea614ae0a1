"""Registered queries over the adapted tables, each with SQL for the same result."""
