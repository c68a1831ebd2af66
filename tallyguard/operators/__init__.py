"""Reusable DataFrame operators: windows, caps, set operations and the generic rule primitives."""
