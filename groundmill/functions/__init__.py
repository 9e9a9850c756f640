"""Column functions: text, hashing and JSON picks."""
