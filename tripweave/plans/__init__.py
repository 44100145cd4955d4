"""Registered queries: the operators on the driver tables, with their SQL twins."""
