"""Queries: operators applied to the tables, each with the SQL it is held against."""
