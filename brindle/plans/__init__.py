"""The logical form of a query: conditions, clauses and their compilation to a DataFrame."""
