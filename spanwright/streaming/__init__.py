"""Stateful operators, each for a stream and for a table."""
