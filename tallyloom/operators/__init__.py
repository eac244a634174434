"""DataFrame-to-DataFrame operators, grouped by domain."""
