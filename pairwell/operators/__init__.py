"""Operators on cohorts: candidates, matching, weights, balance, estimation."""
