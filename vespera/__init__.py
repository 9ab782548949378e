"""Horizon-visibility analytics on Spark."""
