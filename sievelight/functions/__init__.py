"""Column expressions: lines, entropy, fingerprints, redaction, paths."""
