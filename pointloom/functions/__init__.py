"""Column expressions: single-precision geometry, random sequences, fingerprints, colours."""
