"""Column expressions: directions and grids, sun and sky, glare."""
