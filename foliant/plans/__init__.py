"""Queries: operators applied to the given tables, each with the SQL that it must equal."""
