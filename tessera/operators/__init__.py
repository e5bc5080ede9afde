"""Operators of the evidence engine."""
