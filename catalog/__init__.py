"""Queries over the given tables, one or more per operator, each with its SQL oracle."""
