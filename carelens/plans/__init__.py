"""carelens.plans."""
