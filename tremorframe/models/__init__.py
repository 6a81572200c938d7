"""Spark ML models on time folds."""
