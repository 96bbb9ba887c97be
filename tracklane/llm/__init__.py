"""Operators for training data, one module each; ``queries`` registers them."""
