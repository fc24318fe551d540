"""Operators on voxel, cohort, inventory and run tables."""
