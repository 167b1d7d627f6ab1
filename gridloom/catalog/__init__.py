"""Queries over the driver's tables, one or more for each operator, each with its SQL where SQL can express it."""
