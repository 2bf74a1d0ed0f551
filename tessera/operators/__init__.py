"""Operators on dense index spaces."""
