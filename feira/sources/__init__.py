"""Inputs and outputs: base tables, the three analysis inputs, the state
dimension, CSV export and persistence helpers."""
