"""Column functions: geometry, projection, hexagon grid, line simplification."""
