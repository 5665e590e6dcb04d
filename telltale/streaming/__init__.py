"""Scoring streams."""
