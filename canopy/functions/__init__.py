"""Column functions: vectors, cameras, formatting."""
