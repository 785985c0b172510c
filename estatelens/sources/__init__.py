"""Landed tables and the rules that decide which files are read."""
