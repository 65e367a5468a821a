"""Scalar functions with the Postgres meaning, as Column expressions."""
