"""Operators for large training-data pipelines. Nothing else in payguard imports this package."""
