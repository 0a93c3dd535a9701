"""Column expressions: distances, geometry and names."""
