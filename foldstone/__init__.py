"""Spatial feature engineering and honest model validation, planned by Spark."""
