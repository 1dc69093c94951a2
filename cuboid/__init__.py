"""cuboid: 3D-perception analytics and training-data preparation as Spark jobs."""
