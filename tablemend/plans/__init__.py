"""Cleaning jobs composed from the operators."""
