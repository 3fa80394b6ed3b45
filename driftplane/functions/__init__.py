"""Column functions: vectors on the unit sphere, quaternions, projections, palettes."""
