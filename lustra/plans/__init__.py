"""Configured sequences of operators."""
