"""Column expressions: ids, names, score tokens, cleaning and the point model."""
