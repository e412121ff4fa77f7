"""Typed, versioned time series on Spark."""
