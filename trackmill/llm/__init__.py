"""Operators of a pipeline for training data. Nothing outside imports this package."""
