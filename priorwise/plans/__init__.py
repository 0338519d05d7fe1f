"""Whole jobs and the query catalog."""
