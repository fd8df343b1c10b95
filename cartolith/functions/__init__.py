"""functions of the cartolith package."""
