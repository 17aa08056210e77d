"""Queries: operators put to work on tables, each beside the SQL that gives the same rows."""
