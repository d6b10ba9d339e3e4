"""Operators over genotypes, cohorts, results and annotations."""
