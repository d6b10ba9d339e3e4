"""Readers of study files."""
