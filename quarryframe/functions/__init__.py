"""Column functions: identities, normalisers, embeddings."""
