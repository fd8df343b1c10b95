"""sources of the cartolith package."""
