"""Scalar rules: pure functions from Column to Column."""
