"""Relational, interval, vector, graph and evaluation operators."""
