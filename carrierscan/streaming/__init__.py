"""Incremental use of the same operators."""
