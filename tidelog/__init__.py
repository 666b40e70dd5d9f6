"""Tidelog: analytics over append-only observation logs, as Spark plans."""
