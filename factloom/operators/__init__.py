"""Relational operators: picks, comparisons, rules, statistics, matching, series."""
