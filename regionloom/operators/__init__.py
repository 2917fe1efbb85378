"""Aggregations, sketches, reports and costs."""
