"""Subpackage of quarryline."""
