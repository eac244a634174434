"""Registered queries: each binds operators to the bundled tables and states its SQL."""
