"""carelens.sources."""
