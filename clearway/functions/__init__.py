"""Column functions: occupancy codes, voxel geometry and numeric helpers."""
