"""Operators: trigrams (P/A/F), provenance (L), sets and splits (U/K/P6),
tests (A3-A5, X1) and minimisation (D1-D5, X2)."""
