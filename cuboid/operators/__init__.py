"""Operators of the 3D engine."""
