"""Relational operators, DataFrame to DataFrame; every one takes its thresholds as arguments."""
