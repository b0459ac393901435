"""Registered queries on the given tables, each beside its SQL twin."""
