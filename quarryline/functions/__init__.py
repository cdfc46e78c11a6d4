"""Quarryline."""
