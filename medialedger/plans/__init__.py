"""Registered queries over the test tables, each with its SQL."""
