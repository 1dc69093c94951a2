"""Sources of the 3D engine."""
