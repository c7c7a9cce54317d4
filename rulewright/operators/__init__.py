"""Matching, stateful patterns, ruleset analysis and analytics over DataFrames."""
