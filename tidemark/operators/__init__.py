"""Joins, aggregations and checks over series."""
