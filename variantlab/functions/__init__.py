"""Column expressions: text cleaning, rates and weights, feature names."""
