"""Bindings to the test tables, the query catalogue and its SQL."""
