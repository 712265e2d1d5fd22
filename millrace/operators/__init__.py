"""Operators that Spark lacks as such, composed of those it has."""
