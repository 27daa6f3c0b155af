"""Column-level building blocks: text, vectors and seeded hashing."""
