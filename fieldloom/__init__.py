"""Analytics over systems of quadratic constraints, and operators for training corpora, on Spark."""
