"""Gauges, transition tracking, error rates and sketch upserts as streams."""
