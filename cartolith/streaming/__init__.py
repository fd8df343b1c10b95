"""streaming of the cartolith package."""
