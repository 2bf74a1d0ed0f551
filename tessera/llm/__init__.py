"""Operators for preparing training data, kept apart from the array engine."""
