"""Streaming of the 3D engine."""
