"""Shared physical strategies (skew-safe joins, distributed order) and whole flows."""
