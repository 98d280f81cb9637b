"""Column functions: text, derivations and arrays."""
