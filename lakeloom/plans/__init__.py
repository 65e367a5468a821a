"""Registered queries: the order-processing suite and one query or more for each operator."""
