"""Operators on long tables keyed by asset and session."""
