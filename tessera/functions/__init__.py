"""Column functions: index algebra and array expressions."""
