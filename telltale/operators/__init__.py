"""Operators on DataFrames of texts: scores, findings, reports, evaluation."""
