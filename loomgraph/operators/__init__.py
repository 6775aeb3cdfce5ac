"""Relational, graph and text operators."""
