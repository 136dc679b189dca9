"""Column functions: each takes and returns columns, so that Catalyst plans them with the query."""
