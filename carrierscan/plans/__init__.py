"""Pipelines made of operators, their state, and the registered queries."""
