"""Registered queries and their independent SQL twins."""
