"""Functions of the 3D engine."""
