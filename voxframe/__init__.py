"""voxframe: voxel and cohort analytics as Spark DataFrame operators."""
