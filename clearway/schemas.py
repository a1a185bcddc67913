"""Column layout of the tables every operator works on."""

from __future__ import annotations

# Key of one frame. ``t`` is the dense frame index 0..n-1 inside a scene, not seconds.
FRAME_KEY = ["scene", "t"]
CELL_KEY = ["scene", "t", "i", "j", "k"]

# Ego pose and vehicle size of a frame; fwd_x / fwd_y are cos / sin of the heading, computed once.
POSE = ["ex", "ey", "fwd_x", "fwd_y", "speed", "width", "length", "height"]
# Grid calibration: the origin is the world coordinate of the CENTRE of voxel (0, 0, 0).
CALIBRATION = ["voxel_size", "ox", "oy", "oz", "ground_height"]
FRAME_ATTRS = POSE + CALIBRATION

FRAMES = (
    "scene STRING, t INT, time_s DOUBLE, ex DOUBLE, ey DOUBLE, ez DOUBLE, heading DOUBLE, "
    "fwd_x DOUBLE, fwd_y DOUBLE, speed DOUBLE, width DOUBLE, length DOUBLE, height DOUBLE, "
    "voxel_size DOUBLE, ox DOUBLE, oy DOUBLE, oz DOUBLE, ground_height DOUBLE"
)
# Sparse: FREE cells are never stored.
VOXELS = "scene STRING, t INT, i INT, j INT, k INT, state INT"
BOXES = (
    "scene STRING, t INT, box_id INT, cx DOUBLE, cy DOUBLE, cz DOUBLE, sx DOUBLE, sy DOUBLE, sz DOUBLE, "
    "yaw DOUBLE, label STRING, vx DOUBLE, vy DOUBLE"
)
BOX_ATTRS = ["cx", "cy", "cz", "sx", "sy", "sz", "yaw", "label", "vx", "vy"]
RAYS = "ray_id BIGINT, scene STRING, t INT, si INT, sj INT, sk INT, di INT, dj INT, dk INT"
POSES = "scene STRING, token STRING, pos INT, prev STRING, next STRING, ts_us BIGINT, tx DOUBLE, ty DOUBLE"
TRUTH = "query_id STRING, scene STRING"
