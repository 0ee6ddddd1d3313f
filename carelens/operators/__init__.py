"""carelens.operators."""
