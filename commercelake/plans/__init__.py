"""Registered queries: each binds operators to the test tables and states its SQL twin."""
