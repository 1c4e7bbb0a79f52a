"""Operators for building a training corpus, their queries and the SQL these must equal."""
