"""Column functions: patterns, spans, tokens, risk, hashes."""
