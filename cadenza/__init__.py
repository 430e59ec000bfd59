"""Causal panel analytics on Spark."""
