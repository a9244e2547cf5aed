"""Operators for building training corpora, their bound queries and the SQL they must equal."""
