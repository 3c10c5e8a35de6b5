"""Captures, keys, rules, and captures made of tables."""
