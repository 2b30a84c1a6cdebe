"""Registered queries: table adapters, Spark plans and their SQL twins."""
