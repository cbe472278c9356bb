"""Operators on DataFrames: scores, thresholds, metrics, resampling, selection, checks."""
