"""Operators from DataFrame to DataFrame; none collects."""
