"""Whole comparisons, composed of operators."""
