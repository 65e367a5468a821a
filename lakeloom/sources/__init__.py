"""Readers and writers of delimited files and of tables described by JSON."""
