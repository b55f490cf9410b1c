"""Operators: scope, comparisons, grids, distributions, ranking, risk, profile, quantiles."""
