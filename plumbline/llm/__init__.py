"""Operators of a training-data pipeline; each module states its method, its bounds and its edge cases."""
