"""Spark jobs for tagged entities, their versions and their time series."""
