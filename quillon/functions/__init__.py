"""Column functions: text folding and tokens, protocol vocabulary, geometry."""
