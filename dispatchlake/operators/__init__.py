"""DataFrame operators, each keyed by trace and running on all traces at once."""
