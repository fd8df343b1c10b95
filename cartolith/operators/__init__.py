"""operators of the cartolith package."""
