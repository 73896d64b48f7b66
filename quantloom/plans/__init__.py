"""Strategies, validation, research runs and reports."""
