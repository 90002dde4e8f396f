"""Readers: each returns a DataFrame over files Spark splits and reads in parallel."""
