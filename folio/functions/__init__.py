"""Column expressions: text, quotes, vectors and posting lists."""
