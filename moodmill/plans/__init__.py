"""Whole chains built from the operators, and the registered queries."""
