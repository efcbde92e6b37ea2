"""Volumetric analytics on Spark: volumes are relations of voxels in global coordinates."""
