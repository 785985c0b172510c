"""Whole-estate plans composed from the operators."""
