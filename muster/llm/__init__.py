"""Operators for preparing training data: text tables in, decisions or packed sequences out."""
