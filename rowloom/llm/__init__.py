"""Operators for training-data pipelines, and their registered queries."""
