"""Operators beyond one query's clauses: relations, regrouping, changes, search and caching."""
