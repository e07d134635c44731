"""DataFrame to DataFrame operators: retrieval, quotes, titles, vectors, n-grams, spelling, extraction."""
