"""orientlake: particle tables, poses and reconstructions as Spark jobs."""
