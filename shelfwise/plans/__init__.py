"""Loads, checks and reports built from the operators."""
