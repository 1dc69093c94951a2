"""Plans of the 3D engine."""
