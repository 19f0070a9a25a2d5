"""Column-expression building blocks (text features, lexicons, lemmas)."""
