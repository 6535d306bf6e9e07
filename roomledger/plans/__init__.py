"""Whole jobs put together from the operators, and the registered queries."""
