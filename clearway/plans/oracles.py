"""The same results in plain SQL (DuckDB dialect), written independently of the Spark plans."""

from __future__ import annotations

Q1, Q2, Q3, Q4 = (
    "tight_clearance_at_speed", "corridor_narrows_below_vehicle_width", "blocked_then_clears", "near_a_tracked_vehicle"
)

# Named sub-queries in dependency order; each statement pulls in the ones it mentions.
PARTS = {
    "frames": """
        SELECT o_custkey AS scene, o_orderkey AS fkey,
               CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS t,
               epoch_us(o_orderdate) / 1e6::DOUBLE AS time_s, floor(o_totalprice / 25000.0::DOUBLE) AS speed
        FROM orders""",
    "strip": """
        SELECT f.scene, f.t, f.fkey, f.speed,
               CAST((l_partkey * 7 + l_linenumber * 5) % 52 AS INT) AS i0,
               CAST((l_suppkey * 3 + l_linenumber) % 12 AS INT) AS dj,
               CAST(l_linenumber - 1 AS INT) AS k, CAST((l_partkey + l_linenumber) % 18 AS INT) AS cls,
               CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE 1 END AS mask_lidar,
               CASE WHEN l_partkey % 4 = 0 THEN 0 ELSE 1 END AS mask_camera, l_linestatus
        FROM lineitem JOIN frames f ON l_orderkey = f.fkey""",
    "cells": """
        SELECT scene, t, i0 + d AS i, 12 + s * dj AS j, k, cls, mask_lidar, mask_camera,
               CASE WHEN cls IN (11, 12, 13, 14, 17) THEN 0 ELSE 1 END AS dense
        FROM strip, unnest(range(8)) AS u(d), (VALUES (1), (-1)) AS v(s)
        WHERE s = 1 OR l_linestatus = 'O'""",
    "voxels": """
        SELECT scene, t, CAST(i AS INT) AS i, CAST(j AS INT) AS j, k, max(state) AS state
        FROM (SELECT *, CASE WHEN mask_lidar = 0 THEN -1 ELSE dense END AS state FROM cells)
        WHERE state <> 0 GROUP BY ALL""",
    "boxes": """
        SELECT DISTINCT scene, t, ((i0 * 16 + dj) * 8 + k) * 32 + cls AS box_id, -5 + i0 * 0.5::DOUBLE AS cx,
               -6 + (dj + 12) * 0.5::DOUBLE AS cy, k * 0.5::DOUBLE AS cz,
               CASE cls % 3 WHEN 0 THEN 'vehicle' WHEN 1 THEN 'pedestrian' ELSE 'cone' END AS label
        FROM strip WHERE l_linestatus = 'F'""",
    "rays": """
        SELECT ((fkey * 64 + i0) * 32 + dj + 12) * 8 + k AS ray_id, scene, t, 10 AS si, 12 AS sj, 2 AS sk,
               i0 AS di, dj + 12 AS dj, k AS dk, min(mask_lidar) = 1 AS observed
        FROM strip GROUP BY fkey, scene, t, i0, strip.dj, k""",
    "stamped": """
        SELECT user_id AS scene, CAST(event_id AS VARCHAR) AS token, event_id, epoch_us(ts) AS ts_us, value AS tx,
               CAST(json_extract_string(props, '$.k') AS DOUBLE) AS ty,
               CAST(row_number() OVER w - 1 AS INT) AS t,
               lag(CAST(event_id AS VARCHAR)) OVER w AS older, lead(CAST(event_id AS VARCHAR)) OVER w AS newer
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "truth": f"""
        SELECT DISTINCT ['{Q1}', '{Q2}', '{Q3}', '{Q4}'][CAST(o_custkey % 4 + 1 AS INT)] AS query_id,
               o_custkey AS scene FROM orders""",
    "obs": """
        SELECT v.scene, v.t, v.i, v.j, v.k, v.state = 1 AS solid, -5 + v.i * 0.5::DOUBLE AS fwd,
               -6 + v.j * 0.5::DOUBLE AS lat, f.speed
        FROM voxels v JOIN frames f ON v.scene = f.scene AND v.t = f.t
        WHERE v.k * 0.5::DOUBLE > 0.25::DOUBLE AND v.k * 0.5::DOUBLE <= 0.25::DOUBLE + 1.9::DOUBLE""",
    "touching": """
        SELECT a.scene, a.t, a.state, a.i, a.j, a.k, b.i AS bi, b.j AS bj, b.k AS bk,
               abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1 AS over_face
        FROM voxels a, unnest(range(-1, 2)) AS x(di), unnest(range(-1, 2)) AS y(dj), unnest(range(-1, 2)) AS z(dk), voxels b
        WHERE b.scene = a.scene AND b.t = a.t AND b.state = a.state AND b.i = a.i + di AND b.j = a.j + y.dj AND b.k = a.k + dk""",
    "reached": """
        SELECT scene, t, state, i, j, k, i AS ri, j AS rj, k AS rk FROM voxels
        UNION SELECT r.scene, r.t, r.state, r.i, r.j, r.k, n.bi, n.bj, n.bk FROM reached r JOIN touching n
          ON n.scene = r.scene AND n.t = r.t AND n.state = r.state AND n.i = r.ri AND n.j = r.rj AND n.k = r.rk""",
    "reached_over_faces": """
        SELECT scene, t, i, j, k, i AS ri, j AS rj, k AS rk FROM voxels WHERE state = 1
        UNION SELECT r.scene, r.t, r.i, r.j, r.k, n.bi, n.bj, n.bk FROM reached_over_faces r JOIN touching n
          ON n.scene = r.scene AND n.t = r.t AND n.state = 1 AND n.i = r.ri AND n.j = r.rj AND n.k = r.rk AND n.over_face""",
    "clustered": """
        SELECT scene, t, state, i, j, k, count(*) AS cells, min({'k': rk, 'j': rj, 'i': ri}) AS head FROM reached GROUP BY ALL""",
    "policies": "SELECT * FROM (VALUES ('free'), ('occupied')) AS p(policy)",
    "quiet_near": """
        SELECT policy, v.scene, v.t, min(abs(-6 + v.j * 0.5::DOUBLE) - (1.85::DOUBLE / 2 + 0.25::DOUBLE)) AS clearance
        FROM clustered v, policies
        WHERE (v.state = 1 OR policy = 'occupied') AND v.cells >= 12 AND v.k * 0.5::DOUBLE > 0.25::DOUBLE AND v.k * 0.5::DOUBLE <= 0.25::DOUBLE + 1.9::DOUBLE
          AND -5 + v.i * 0.5::DOUBLE BETWEEN 0 AND 20 AND abs(-6 + v.j * 0.5::DOUBLE) > 1.85::DOUBLE / 2 + 0.25::DOUBLE
        GROUP BY policy, v.scene, v.t""",
    "view": "SELECT policy, obs.* FROM obs, policies WHERE solid OR policy = 'occupied'",
    "near": """
        SELECT policy, scene, t,
               min(CASE WHEN fwd >= 0 AND fwd <= 20 THEN abs(lat) END) AS centerline,
               min(CASE WHEN fwd >= 0 AND fwd <= 20 AND abs(lat) > 1.85::DOUBLE / 2 + 0.25::DOUBLE
                        THEN abs(lat) - (1.85::DOUBLE / 2 + 0.25::DOUBLE) END) AS clearance,
               min(CASE WHEN fwd >= 0 AND fwd <= 3 AND abs(lat) > 1.85::DOUBLE / 2 + 0.25::DOUBLE
                        THEN abs(lat) - (1.85::DOUBLE / 2 + 0.25::DOUBLE) END) AS abeam,
               bool_or(fwd >= 0 AND fwd <= 4.6::DOUBLE / 2 + 0.25::DOUBLE
                       AND abs(lat) <= 1.85::DOUBLE / 2 + 0.25::DOUBLE) AS hit_0s,
               bool_or(fwd >= 0 AND fwd <= 4.6::DOUBLE / 2 + speed * 0.5::DOUBLE + 0.25::DOUBLE
                       AND abs(lat) <= 1.85::DOUBLE / 2 + 0.25::DOUBLE) AS hit_0p5s,
               bool_or(fwd >= 0 AND fwd <= 4.6::DOUBLE / 2 + speed * 1.0::DOUBLE + 0.25::DOUBLE
                       AND abs(lat) <= 1.85::DOUBLE / 2 + 0.25::DOUBLE) AS hit_1s
        FROM view GROUP BY policy, scene, t""",
    "slices": """
        SELECT policy, scene, t, s.station, speed,
               min(CASE WHEN lat > 0 THEN greatest(0, lat - 0.25::DOUBLE) END)
               + min(CASE WHEN lat < 0 THEN greatest(0, -lat - 0.25::DOUBLE) END) AS gap,
               min(CASE WHEN lat > 0 THEN lat - 0.25::DOUBLE END) AS "left",
               max(CASE WHEN lat < 0 THEN lat + 0.25::DOUBLE END) AS "right"
        FROM view JOIN (SELECT CAST(range AS INT) AS station FROM range(300)) s
          ON abs(fwd - s.station * 0.5::DOUBLE) <= 0.25::DOUBLE
        GROUP BY ALL""",
    "widths": """
        SELECT policy, scene, t,
               min(CASE WHEN station * 0.5::DOUBLE <= 4.6::DOUBLE / 2 + speed * 0.5::DOUBLE + 1e-9::DOUBLE THEN gap END) AS w_0p5s,
               min(CASE WHEN station * 0.5::DOUBLE <= 4.6::DOUBLE / 2 + speed * 2.0::DOUBLE + 1e-9::DOUBLE THEN gap END) AS w_2s
        FROM slices GROUP BY ALL""",
    "box_min": """
        SELECT scene, t, min(sqrt(cx * cx + cy * cy)) AS any_box,
               min(CASE WHEN label = 'vehicle' THEN sqrt(cx * cx + cy * cy) END) AS vehicle,
               min(CASE WHEN label = 'pedestrian' THEN sqrt(cx * cx + cy * cy) END) AS pedestrian,
               min(CASE WHEN label = 'cone' THEN sqrt(cx * cx + cy * cy) END) AS cone
        FROM boxes GROUP BY scene, t""",
    "fm": """
        SELECT p.policy, f.scene, f.t, f.speed, centerline, clearance, abeam,
               NOT coalesce(hit_0s, false) AS path_0s, NOT coalesce(hit_0p5s, false) AS path_0p5s,
               NOT coalesce(hit_1s, false) AS path_1s,
               CASE WHEN w_0p5s < 0.5 THEN 0.0::DOUBLE ELSE w_0p5s END AS w_0p5s,
               CASE WHEN w_2s < 0.5 THEN 0.0::DOUBLE ELSE w_2s END AS w_2s
        FROM frames f CROSS JOIN policies p
        LEFT JOIN near n ON n.policy = p.policy AND n.scene = f.scene AND n.t = f.t
        LEFT JOIN widths w ON w.policy = p.policy AND w.scene = f.scene AND w.t = f.t""",
    "cheap_fm": """
        SELECT p.policy, f.scene, f.t, f.speed, centerline, clearance, abeam,
               NOT coalesce(hit_0s, false) AS path_0s, NOT coalesce(hit_0p5s, false) AS path_0p5s,
               NOT coalesce(hit_1s, false) AS path_1s
        FROM frames f CROSS JOIN policies p
        LEFT JOIN near n ON n.policy = p.policy AND n.scene = f.scene AND n.t = f.t""",
    "m1": f"""
        SELECT DISTINCT '{Q1}' AS query_id, policy, scene FROM cheap_fm WHERE clearance < 0.5 AND speed > 8.33::DOUBLE""",
    "m2": f"""
        SELECT DISTINCT '{Q2}' AS query_id, policy, scene FROM fm WHERE w_2s > 0 AND w_2s < 1.85::DOUBLE""",
    "m3": f"""
        SELECT DISTINCT '{Q3}' AS query_id, a.policy, a.scene FROM cheap_fm a JOIN cheap_fm b
          ON a.policy = b.policy AND a.scene = b.scene AND b.t > a.t AND b.t - a.t <= 3
        WHERE NOT a.path_1s AND b.path_1s""",
    "m4": f"""
        SELECT DISTINCT '{Q4}' AS query_id, policy, scene FROM box_min, policies WHERE vehicle < 2.0""",
    "matches3": "SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3",
    "matches4": "SELECT * FROM matches3 UNION ALL SELECT * FROM m4",
    "sets3": """
        SELECT query_id, scene, bool_or(policy = 'free') AS "free", bool_or(policy = 'occupied') AS occupied,
               count(*) = 2 AS ignored, count(*) = 1 AS undetermined
        FROM matches3 GROUP BY query_id, scene""",
    "got3": """
        SELECT * FROM matches3 UNION ALL SELECT query_id, 'ignored', scene FROM sets3 WHERE ignored""",
    "got4": """
        SELECT * FROM matches4 UNION ALL
        SELECT query_id, 'ignored', scene FROM matches4 GROUP BY query_id, scene HAVING count(*) = 2""",
    "walk": """
        SELECT ray_id, 0 AS pos, si AS i, sj AS j, sk AS k,
               CASE WHEN di <> si THEN 0.5::DOUBLE / abs(di - si) ELSE 'inf'::DOUBLE END AS tx,
               CASE WHEN dj <> sj THEN 0.5::DOUBLE / abs(dj - sj) ELSE 'inf'::DOUBLE END AS ty,
               CASE WHEN dk <> sk THEN 0.5::DOUBLE / abs(dk - sk) ELSE 'inf'::DOUBLE END AS tz,
               di - si AS dx, dj - sj AS dy, dk - sk AS dz, di, dj, dk
        FROM rays WHERE (di, dj, dk) <> (si, sj, sk)
        UNION ALL
        SELECT * FROM (
            SELECT ray_id, pos + 1 AS pos,
                   CASE WHEN tx <= ty AND tx <= tz THEN i + sign(dx) ELSE i END AS i,
                   CASE WHEN NOT (tx <= ty AND tx <= tz) AND ty <= tz THEN j + sign(dy) ELSE j END AS j,
                   CASE WHEN NOT (tx <= ty AND tx <= tz) AND NOT ty <= tz THEN k + sign(dz) ELSE k END AS k,
                   CASE WHEN tx <= ty AND tx <= tz THEN tx + 1.0::DOUBLE / abs(dx) ELSE tx END AS tx,
                   CASE WHEN NOT (tx <= ty AND tx <= tz) AND ty <= tz THEN ty + 1.0::DOUBLE / abs(dy) ELSE ty END AS ty,
                   CASE WHEN NOT (tx <= ty AND tx <= tz) AND NOT ty <= tz THEN tz + 1.0::DOUBLE / abs(dz) ELSE tz END AS tz,
                   dx, dy, dz, di, dj, dk
            FROM walk) WHERE (i, j, k) <> (di, dj, dk)""",
    "ray_cells": "SELECT ray_id, pos, i, j, k FROM walk WHERE pos > 0",
    "depths": """
        SELECT r.ray_id, r.scene, r.t, r.di, r.dj, r.dk, r.observed, count(*) FILTER (WHERE v.state = 1) AS depth,
               count(*) FILTER (WHERE v.state = -1) AS unknown_cells
        FROM rays r LEFT JOIN ray_cells c ON c.ray_id = r.ray_id
        LEFT JOIN voxels v ON v.scene = r.scene AND v.t = r.t AND v.i = c.i AND v.j = c.j AND v.k = c.k
        GROUP BY ALL""",
    "best": "SELECT scene, min(clearance) AS value FROM cheap_fm WHERE policy = 'free' AND speed > 8.33::DOUBLE GROUP BY scene",
    "measured": """
        SELECT *, row_number() OVER (ORDER BY ray_id) AS place, row_number() OVER (ORDER BY mixed, ray_id) AS place2,
               row_number() OVER (PARTITION BY class ORDER BY ray_id) AS inner_place,
               row_number() OVER (PARTITION BY class ORDER BY mixed, ray_id) AS inner_place2
        FROM (SELECT ray_id, observed, CAST(depth AS BIGINT) AS depth, CAST((di - 10) * (di - 10) + (dj - 12) * (dj - 12) AS BIGINT) AS distance,
                     floor(sqrt((di - 10) * (di - 10) + (dj - 12) * (dj - 12)) / 8) AS class, (ray_id % 1000003) * 7919 % 1000003 AS mixed
              FROM depths)""",
    "ranked": """
        SELECT a.ray_id, a.observed, a.depth, a.distance, b.depth AS shuffled_depth, c.depth AS matched_depth
        FROM measured a JOIN measured b ON b.place2 = a.place JOIN measured c ON c.class = a.class AND c.inner_place2 = a.inner_place""",
}


RECURSIVE = {"walk", "reached", "reached_over_faces"}


def sql(select: str, recursive: bool = False) -> str:
    """A statement with the parts that ``select`` mentions, directly or through other parts."""
    used: list[str] = []

    def pull(text: str) -> None:
        for name in PARTS:
            mentioned = any(w.strip("(),;") == name or w.strip("(),;").startswith(name + ".") for w in text.split())
            if mentioned and name not in used:
                used.append(name)
                pull(PARTS[name])

    pull(select)
    head = "WITH RECURSIVE " if RECURSIVE & set(used) else "WITH "
    parts = [
        f"{n} AS ({PARTS[n]})" if n in RECURSIVE | {"policies"} else f"{n} AS MATERIALIZED ({PARTS[n]})"
        for n in PARTS if n in used
    ]
    return (head + ",\n".join(parts) + "\n" if parts else "") + select


def shown(expression: str, name: str) -> str:
    """Sink form of a distance: rounded and NULL when open, plus the open flag."""
    return f"round({expression}, 6) AS {name}, {expression} IS NULL AS {name}_open"


def pivoted(value: str, names: str) -> str:
    """Both policies of a metric side by side, in sink form."""
    return ", ".join(
        f"{shown(f'max(CASE WHEN policy = {chr(39)}{p}{chr(39)} THEN {value} END)', f'{names}_{p}')}"
        for p in ("free", "occupied")
    )


def flag(value: str, name: str) -> str:
    return ", ".join(f"bool_and({value}) FILTER (policy = '{p}') AS {name}_{p}" for p in ("free", "occupied"))


SCORES = """
    round_even(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 1 END, 3) AS "precision",
    round_even(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 1 END, 3) AS recall,
    round_even(CASE WHEN (CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 1 END)
                       + (CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 1 END) > 0
               THEN 2 * (CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 1 END)
                      * (CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 1 END)
                    / ((CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 1 END)
                     + (CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 1 END)) ELSE 0 END, 3) AS f1"""

# Counts per (query, policy) from rows "got" (query_id, policy, scene) and the truth.
def counts(got: str, pairs: str) -> str:
    return f"""
        SELECT k.query_id, k.policy, count(*) FILTER (WHERE g AND w) AS tp, count(*) FILTER (WHERE g AND NOT w) AS fp,
               count(*) FILTER (WHERE NOT g AND w) AS fn
        FROM {pairs} AS k LEFT JOIN (
            SELECT query_id, policy, scene, bool_or(g) AS g, bool_or(w) AS w FROM (
                SELECT query_id, policy, scene, true AS g, false AS w FROM {got}
                UNION ALL
                SELECT query_id, policy, scene, false, true FROM truth ,
                       (VALUES ('free'), ('occupied'), ('ignored')) AS q(policy))
            GROUP BY ALL) AS o ON o.query_id = k.query_id AND o.policy = k.policy
        GROUP BY k.query_id, k.policy"""


PAIRS3 = f"""(SELECT query_id, policy FROM (VALUES ('{Q1}'), ('{Q2}'), ('{Q3}')) AS a(query_id),
             (VALUES ('free'), ('occupied'), ('ignored')) AS b(policy))"""
ALL_QUERIES = f"(VALUES ('{Q1}'), ('{Q2}'), ('{Q3}'), ('{Q4}'), ('unlabelled'))"

REPORT3 = f"""
    SELECT c.query_id, c.policy, tp, fp, fn, {SCORES}, tp + fp AS retrieved,
           coalesce(u.n, 0) AS undetermined, coalesce(u.n, 0) = 0 AS unknown_stable
    FROM ({counts('got3', PAIRS3)}) AS c
    LEFT JOIN (SELECT query_id, count(*) AS n FROM sets3 WHERE undetermined GROUP BY query_id) AS u ON u.query_id = c.query_id"""
BASELINE4 = f"""
    SELECT query_id, tp, fp, fn, {SCORES}, tp + fp AS retrieved
    FROM ({counts('m4', f"(SELECT '{Q4}' AS query_id, 'free' AS policy)")}) AS c"""
FULL_REPORT = f"""
    SELECT r.*, CASE WHEN query_id = '{Q4}' THEN 'tracking' ELSE 'occupancy' END AS backend,
           CASE WHEN query_id = '{Q4}' THEN 'baseline_only' ELSE 'implemented' END AS status,
           CASE WHEN query_id = '{Q3}' THEN 'transition' ELSE 'any' END AS scope,
           query_id = '{Q4}' AS box_expressible, query_id <> '{Q4}' AS is_occupancy
    FROM ({REPORT3}
          UNION ALL
          SELECT query_id, 'any' AS policy, tp, fp, fn, "precision", recall, f1, retrieved, 0, true FROM ({BASELINE4})) AS r"""


def one_query(part: str) -> str:
    return f"""SELECT query_id, policy, scene FROM {part} UNION ALL
               SELECT query_id, 'ignored', scene FROM {part} GROUP BY query_id, scene HAVING count(*) = 2"""


def masked_matches(mask: str) -> str:
    """Retrieval on another reading of the label volumes: the same parts with another state."""
    state = {"none": "dense", "camera": "CASE WHEN mask_camera = 0 THEN -1 ELSE dense END"}.get(mask)
    base = sql("SELECT * FROM got3")
    return base if state is None else base.replace("CASE WHEN mask_lidar = 0 THEN -1 ELSE dense END", state)


ORACLES = {
    "q1_tight_clearance_at_speed": sql(one_query("m1")),
    "q2_corridor_narrows": sql(one_query("m2")),
    "q3_blocked_then_clears": sql(one_query("m3")),
    "q4_near_tracked_vehicle": sql(one_query("m4")),
    "retrieval_batch": sql("SELECT query_id, policy, scene FROM got4"),
    "scene_index_scan": sql("""
        SELECT CAST(scene AS VARCHAR) AS scene, token, CAST(t % 64 AS INT) AS pos, older AS prev, newer AS next, ts_us, tx, ty,
               'gts/' || token || '/labels.npz' AS gt_path FROM stamped"""),
    "scene_index_ranges": sql("""
        SELECT CAST(scene AS VARCHAR) AS scene, token, older AS prev, newer AS next, ts_us, tx, ty,
               'gts/' || token || '/labels.npz' AS gt_path FROM stamped"""),
    "scene_index_order": sql("SELECT CAST(scene AS VARCHAR) AS scene, token, t FROM stamped"),
    "sorted_names": sql("SELECT scene, CAST(row_number() OVER (ORDER BY scene) - 1 AS INT) AS place FROM (SELECT DISTINCT scene FROM frames )"),
    "label_volume_files": sql("SELECT scene, t, i, j, k, state FROM voxels"),
    "label_volume_source": sql("SELECT scene, t, i, j, k, state FROM voxels"),
    "requested_scenes_missing": "SELECT DISTINCT p_partkey AS scene FROM part WHERE p_partkey NOT IN (SELECT o_custkey FROM orders)",
    "frame_assembly": sql("""
        SELECT f.scene, f.t, f.time_s, f.speed, coalesce(n_occupied, 0) AS n_occupied, coalesce(n_unknown, 0) AS n_unknown,
               coalesce(n_boxes, 0) AS n_boxes
        FROM frames f
        LEFT JOIN (SELECT scene, t, count_if(state = 1) AS n_occupied, count_if(state = -1) AS n_unknown
                   FROM voxels GROUP BY scene, t) v ON v.scene = f.scene AND v.t = f.t
        LEFT JOIN (SELECT scene, t, count(*) AS n_boxes FROM boxes GROUP BY scene, t) b ON b.scene = f.scene AND b.t = f.t"""),
    "frame_voxel_join": sql("""
        SELECT v.scene, count(*) AS cells, sum(f.speed) AS speed_sum, sum(-5 + v.i * 0.5::DOUBLE) AS x_sum
        FROM voxels v JOIN frames f ON v.scene = f.scene AND v.t = f.t GROUP BY v.scene"""),
    "frame_box_join": sql("""
        SELECT f.scene, f.t, f.speed, b.box_id, b.label, b.cx, b.cy
        FROM frames f LEFT JOIN boxes b ON b.scene = f.scene AND b.t = f.t"""),
    "truth_labels": sql(f"""
        SELECT q.query_id, count(tr.scene) AS truth_scenes FROM {ALL_QUERIES} AS q(query_id)
        LEFT JOIN truth AS tr ON tr.query_id = q.query_id GROUP BY q.query_id"""),
    "report_sink": sql(FULL_REPORT),
    "report_replaced_queries": sql(f"SELECT query_id, policy, tp, fp, fn FROM ({FULL_REPORT}) WHERE query_id <> '{Q1}' OR policy = 'occupied'"),
    "label_volume_ingest": sql("SELECT scene, t, i, j, k, state FROM voxels"),
    "class_states": sql("""
        SELECT cls, mask_lidar, mask_camera, dense, CASE WHEN mask_lidar = 0 THEN -1 ELSE dense END AS lidar,
               CASE WHEN mask_camera = 0 THEN -1 ELSE dense END AS camera, count(*) AS strips
        FROM (SELECT *, CASE WHEN cls IN (11, 12, 13, 14, 17) THEN 0 ELSE 1 END AS dense FROM strip) GROUP BY ALL"""),
    "voxel_world_positions": sql("""
        SELECT scene, t, min(-5 + i * 0.5::DOUBLE) AS x_min, max(-5 + i * 0.5::DOUBLE) AS x_max,
               sum(-5 + i * 0.5::DOUBLE) AS x_sum, sum(-6 + j * 0.5::DOUBLE) AS y_sum, sum(k * 0.5::DOUBLE) AS z_sum
        FROM voxels GROUP BY scene, t"""),
    "world_voxel_cells": """
        SELECT CAST(round_even(l_quantity * 0.25::DOUBLE / 0.5::DOUBLE, 0) AS INT) AS i,
               CAST(round_even(l_linenumber * 0.25::DOUBLE / 0.5::DOUBLE, 0) AS INT) AS j,
               CAST(round_even(l_suppkey * 0.25::DOUBLE / 0.5::DOUBLE, 0) AS INT) AS k, count(*) AS points
        FROM lineitem GROUP BY ALL""",
    "obstacle_filter": sql("""
        SELECT scene, t, count_if(solid) AS obstacles_free, count(*) AS obstacles_occupied, sum(k * 0.5::DOUBLE) AS z_sum
        FROM obs GROUP BY scene, t"""),
    "obstacle_layers": sql("""
        SELECT scene, t, count_if(solid) AS obstacles_free, count(*) AS obstacles_occupied, sum(k * 0.5::DOUBLE) AS z_sum
        FROM obs GROUP BY scene, t"""),
    "obstacles_uncapped": sql("""
        SELECT scene, t, count(*) AS above_ground, max(k * 0.5::DOUBLE) AS z_max, count_if(k * 0.5::DOUBLE <= 1.25) AS below_one_metre
        FROM voxels WHERE state = 1 AND k * 0.5::DOUBLE > 0.25 GROUP BY scene, t"""),
    "ego_projection": sql("""
        SELECT scene, t, box_id, round(dx * cos(h) + dy * sin(h), 6) + 0.0::DOUBLE AS fwd,
               round(dx * -sin(h) + dy * cos(h), 6) + 0.0::DOUBLE AS lat
        FROM (SELECT b.scene, b.t, b.box_id, (f.fkey % 8) * 0.7853981633974483::DOUBLE AS h,
                     b.cx - f.t * 0.5::DOUBLE AS dx, b.cy + f.t * 0.25::DOUBLE AS dy
              FROM boxes b JOIN frames f ON b.scene = f.scene AND b.t = f.t)"""),
    "grid_bounds_filter": sql("""
        SELECT scene, count(*) AS cells, max(i) AS i_max, max(j) AS j_max FROM voxels
        WHERE i BETWEEN 0 AND 51 AND j BETWEEN 0 AND 19 AND k BETWEEN 0 AND 5 GROUP BY scene"""),
    "frame_accessors": sql("""
        SELECT scene, t, time_s, 0.0::DOUBLE AS ex, 0.0::DOUBLE AS ey, 0.0::DOUBLE AS heading, speed, 1.85::DOUBLE AS width,
               4.6::DOUBLE AS length, 1.9::DOUBLE AS height FROM frames"""),
    "top_down_pillars": sql("""
        SELECT scene, t, count_if(occ) AS occupied, count_if(unk) AS unknown, sum(CASE WHEN occ THEN i * 24 + j END) AS occupied_at
        FROM (SELECT scene, t, i, j, bool_or(solid) AS occ, bool_or(NOT solid) AS unk FROM obs GROUP BY scene, t, i, j)
        GROUP BY scene, t"""),
    "metrics_on_pillars": sql(f"""
        SELECT scene, t, {pivoted('clearance', 'clearance')}, {pivoted('w_2s', 'free_width_2s')} FROM fm GROUP BY scene, t"""),
    "boolean_expression": sql("""
        SELECT scene, t FROM cheap_fm WHERE policy = 'free'
        AND ((clearance > 0.3 AND clearance <= 1.4 AND speed >= 4 AND speed <> 7) OR (centerline = 0.5 AND NOT speed > 12))"""),
    "box_class_filter": sql(f"""
        SELECT f.scene, f.t, {shown('vehicle', 'box_distance_vehicle')}, {shown('pedestrian', 'box_distance_pedestrian')},
               {shown('cone', 'box_distance_cone')}, {shown('any_box', 'box_distance')}
        FROM frames f LEFT JOIN box_min b ON b.scene = f.scene AND b.t = f.t"""),
    "centerline_distance": sql(f"SELECT scene, t, {pivoted('centerline', 'centerline')} FROM cheap_fm GROUP BY scene, t"),
    "lateral_clearance": sql(f"SELECT scene, t, {pivoted('clearance', 'clearance')} FROM cheap_fm GROUP BY scene, t"),
    "swept_path_free": sql(f"""
        SELECT scene, t, {flag('path_0s', 'path_free_0s')}, {flag('path_0p5s', 'path_free_0p5s')}, {flag('path_1s', 'path_free_1s')}
        FROM cheap_fm GROUP BY scene, t"""),
    "min_free_width": sql(f"""
        SELECT scene, t, {pivoted('w_0p5s', 'free_width_0p5s')}, {pivoted('w_2s', 'free_width_2s')} FROM fm GROUP BY scene, t"""),
    "nearest_box_distance": sql(f"""
        SELECT f.scene, f.t, {shown('vehicle', 'box_distance_vehicle')}
        FROM frames f LEFT JOIN box_min b ON b.scene = f.scene AND b.t = f.t"""),
    "abeam_clearance": sql(f"SELECT scene, t, {pivoted('abeam', 'clearance')} FROM cheap_fm GROUP BY scene, t"),
    "state_counts": sql("""
        SELECT f.scene, f.t, count(*) FILTER (WHERE v.state = 1) AS occupied, count(*) FILTER (WHERE v.state = -1) AS unknown, 60 * 24 * 8 - count(v.state) AS free
        FROM frames f LEFT JOIN voxels v ON v.scene = f.scene AND v.t = f.t GROUP BY f.scene, f.t"""),
    "scene_totals": "SELECT count(DISTINCT o_custkey) AS scenes, count(*) AS frames FROM orders",
    "scope_any": sql("""
        SELECT p_partkey AS scene, coalesce(bool_or(NOT path_0s), false) AS matches
        FROM (SELECT DISTINCT p_partkey FROM part) LEFT JOIN cheap_fm ON scene = p_partkey AND policy = 'free' GROUP BY p_partkey"""),
    "scope_all": sql("""
        SELECT p_partkey AS scene, coalesce(bool_and(path_0s), true) AS matches
        FROM (SELECT DISTINCT p_partkey FROM part) LEFT JOIN cheap_fm ON scene = p_partkey AND policy = 'free' GROUP BY p_partkey"""),
    "scope_transition": sql(f"""
        SELECT scene, t, {flag('starts', 'starts')} FROM (
            SELECT a.policy, a.scene, a.t, NOT a.path_1s AND coalesce(bool_or(b.path_1s), false) AS starts
            FROM cheap_fm a LEFT JOIN cheap_fm b
              ON a.policy = b.policy AND a.scene = b.scene AND b.t > a.t AND b.t - a.t <= 2
            GROUP BY a.policy, a.scene, a.t, a.path_1s) GROUP BY scene, t"""),
    "first_frame_values": sql("SELECT scene, 1.85::DOUBLE AS width, speed FROM frames WHERE t = 0"),
    "transition_by_join": sql("SELECT DISTINCT scene FROM m3 WHERE policy = 'free'"),
    "condition_retrieval": sql("""
        SELECT scene FROM cheap_fm WHERE policy = 'occupied' GROUP BY scene
        HAVING bool_and(coalesce(clearance >= 0.5, true) AND path_1s)"""),
    "persistent_block": sql("""
        SELECT a.scene, a.t, a.run AS persistent, a.run AND coalesce(bool_or(b.path_1s), false) AS clears
        FROM (SELECT scene, t, NOT path_1s AND (coalesce(NOT lag(path_1s) OVER w, false) OR coalesce(NOT lead(path_1s) OVER w, false)) AS run
              FROM cheap_fm WHERE policy = 'free' WINDOW w AS (PARTITION BY scene ORDER BY t)) a
        LEFT JOIN cheap_fm b ON b.policy = 'free' AND b.scene = a.scene AND b.t > a.t AND b.t - a.t <= 3
        GROUP BY a.scene, a.t, a.run"""),
    "ray_traversal": sql("""
        SELECT ray_id, count(*) AS cells, sum(i) AS i_sum, sum(j) AS j_sum, sum(k) AS k_sum,
               sum(pos * (i * 10000 + j * 100 + k)) AS path_sum FROM ray_cells GROUP BY ray_id"""),
    "line_of_sight": sql("""
        SELECT ray_id, scene, t, depth = 0 AS visible, depth + unknown_cells = 0 AS visible_unknown_blocks FROM depths"""),
    "visible_rays": sql("SELECT ray_id FROM depths WHERE depth + unknown_cells = 0"),
    "occlusion_depth": sql("SELECT ray_id, depth, unknown_cells FROM depths"),
    "occlusion_distrust": sql(f"""
        SELECT flag, tp, fp, fn, {SCORES} FROM (
            SELECT flag, count_if(got AND NOT observed) AS tp, count_if(got AND observed) AS fp,
                   count_if(NOT got AND NOT observed) AS fn
            FROM (SELECT 'depth' AS flag, depth > 0 AS got, observed FROM depths
                  UNION ALL
                  SELECT 'distance', (di - 10) * (di - 10) + (dj - 12) * (dj - 12) > 400, observed FROM depths
                  UNION ALL
                  SELECT 'shuffled_depth', coalesce(lead(depth) OVER w, first_value(depth) OVER w) > 0, observed
                  FROM depths WINDOW w AS (PARTITION BY scene, t ORDER BY (ray_id % 1000003) * 7919 % 1000003, ray_id))
            GROUP BY flag)"""),
    "ego_speed": sql("""
        SELECT scene, token, t, round(CASE WHEN dt > 0 THEN sqrt(dx * dx + dy * dy) / dt ELSE 0 END, 6) AS speed
        FROM (SELECT scene, token, t, coalesce((lead(tx) OVER w), (lag(tx) OVER w)) - tx AS dx,
                     coalesce((lead(ty) OVER w), (lag(ty) OVER w)) - ty AS dy,
                     abs(coalesce((lead(ts_us) OVER w), (lag(ts_us) OVER w)) - ts_us) / 1e6::DOUBLE AS dt
              FROM stamped WINDOW w AS (PARTITION BY scene ORDER BY t))"""),
    "link_order": sql("SELECT scene, token, t FROM stamped"),
    "link_order_doubling": sql("""
        SELECT scene, token, CAST(place AS INT) AS t FROM (
            SELECT scene, token, row_number() OVER w - 1 AS place,
                   coalesce(count_if(event_id % 97 = 0) OVER (PARTITION BY scene ORDER BY t DESC
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS breaks
            FROM stamped WINDOW w AS (PARTITION BY scene ORDER BY t DESC)) WHERE breaks = 0"""),
    "representative_frames": sql("""
        SELECT scene,
               arg_min(t, (NOT coalesce(w_2s > 0 AND w_2s < 1.85::DOUBLE, false), coalesce(w_2s, 'inf'::DOUBLE), t)) AS corridor,
               coalesce(min(t) FILTER (NOT path_1s), 0) AS blocked,
               arg_min(t, (NOT speed > 8.33::DOUBLE, coalesce(clearance, 'inf'::DOUBLE), t)) AS tight,
               arg_min(t, (coalesce(clearance, 'inf'::DOUBLE), t)) AS "default"
        FROM fm WHERE policy = 'free' GROUP BY scene"""),
    "clearance_witness": sql("""
        SELECT scene, t, i, j, k, fwd, lat, round(gap, 6) AS clearance FROM (
            SELECT *, abs(lat) - (1.85::DOUBLE / 2 + 0.25::DOUBLE) AS gap FROM obs
            WHERE solid AND fwd >= 0 AND fwd <= 20 AND abs(lat) > 1.85::DOUBLE / 2 + 0.25::DOUBLE)
        QUALIFY row_number() OVER (PARTITION BY scene, t ORDER BY gap, i, j, k) = 1"""),
    "corridor_witness": sql("""
        SELECT scene, t, station, round(gap, 6) AS gap, station * 0.5::DOUBLE AS at, "left", "right" FROM slices
        WHERE policy = 'free' AND gap IS NOT NULL AND station * 0.5::DOUBLE <= 4.6::DOUBLE / 2 + speed * 2.0::DOUBLE + 1e-9::DOUBLE
        QUALIFY row_number() OVER (PARTITION BY scene, t ORDER BY gap, station) = 1"""),
    "box_indistinguishable_frames": sql("""
        SELECT scene, t, answer, n_boxes, group_size, group_matches FROM (
            SELECT *, count(*) OVER w AS group_size, count_if(answer) OVER w AS group_matches FROM (
                SELECT f.scene, f.t, coalesce(f.clearance < 0.5, false) AS answer, coalesce(b.n_boxes, 0) AS n_boxes,
                       coalesce(b.seen, '') AS seen
                FROM cheap_fm f LEFT JOIN (
                    SELECT scene, t, count(*) AS n_boxes, string_agg(seen, ';' ORDER BY seen) AS seen
                    FROM (SELECT scene, t, concat_ws(',', cx, cy, cz, label) AS seen FROM boxes) GROUP BY scene, t) b
                  ON b.scene = f.scene AND b.t = f.t
                WHERE f.policy = 'free') WINDOW w AS (PARTITION BY seen))
        WHERE group_matches > 0 AND group_matches < group_size"""),
    "box_indistinguishable_scenes": sql("""
        SELECT scene, answer, n_boxes, group_size, group_matches FROM (
            SELECT *, count(*) OVER w AS group_size, count_if(answer) OVER w AS group_matches FROM (
                SELECT a.scene, a.answer, coalesce(b.n_boxes, 0) AS n_boxes, coalesce(b.seen, '') AS seen
                FROM (SELECT scene, bool_or(coalesce(clearance < 0.5, false)) AS answer FROM cheap_fm WHERE policy = 'free' GROUP BY scene) a
                LEFT JOIN (
                    SELECT scene, count(*) AS n_boxes, string_agg(seen, ';' ORDER BY seen) AS seen
                    FROM (SELECT scene, concat_ws(',', t, cx, cy, cz, label) AS seen FROM boxes) GROUP BY scene) b
                  ON b.scene = a.scene) WINDOW w AS (PARTITION BY seen))
        WHERE group_matches > 0 AND group_matches < group_size"""),
    "label_indistinguishable_scenes": sql("""
        SELECT scene, answer, n_boxes, group_size, group_matches FROM (
            SELECT *, count(*) OVER w AS group_size, count_if(answer) OVER w AS group_matches FROM (
                SELECT a.scene, a.answer, coalesce(b.n_boxes, 0) AS n_boxes, coalesce(b.seen, '') AS seen
                FROM (SELECT scene, bool_or(coalesce(clearance < 0.5, false)) AS answer FROM cheap_fm WHERE policy = 'free' GROUP BY scene) a
                LEFT JOIN (
                    SELECT scene, count(*) AS n_boxes, concat_ws(',', count_if(label = 'vehicle'), count_if(label = 'pedestrian'), count_if(label = 'cone')) AS seen
                    FROM boxes GROUP BY scene) b
                  ON b.scene = a.scene) WINDOW w AS (PARTITION BY seen))
        WHERE group_matches > 0 AND group_matches < group_size"""),
    "noise_filtered_voxels": sql("""
        SELECT scene, t, count(*) AS cells, sum(n) AS neighbours, sum(i * 192 + j * 8 + k) AS cells_at FROM (
            SELECT a.scene, a.t, a.i, a.j, a.k, count(*) AS n
            FROM voxels a, unnest(range(-1, 2)) AS x(di), unnest(range(-1, 2)) AS y(dj), unnest(range(-1, 2)) AS z(dk), voxels b
            WHERE a.state = 1 AND b.state = 1 AND (di <> 0 OR y.dj <> 0 OR dk <> 0)
              AND b.scene = a.scene AND b.t = a.t AND b.i = a.i + di AND b.j = a.j + y.dj AND b.k = a.k + dk
            GROUP BY ALL HAVING count(*) >= 2) GROUP BY scene, t"""),
    "voxel_clusters": sql("""
        SELECT scene, t, state, head.i AS first_i, head.j AS first_j, head.k AS first_k, max(cells) AS cells,
               min(i) AS i_min, max(i) AS i_max, min(j) AS j_min, max(j) AS j_max, min(k) AS k_min, max(k) AS k_max
        FROM clustered GROUP BY scene, t, state, head"""),
    "cluster_filtered_voxels": sql("""
        SELECT scene, t, count(*) AS cells, sum(i * 192 + j * 8 + k) AS cells_at FROM (
            SELECT scene, t, i, j, k FROM reached_over_faces GROUP BY ALL HAVING count(*) >= 12) GROUP BY scene, t"""),
    "clearance_without_noise": sql(f"""
        SELECT f.scene, f.t, {pivoted('clearance', 'clearance')} FROM frames f
        LEFT JOIN quiet_near n ON n.scene = f.scene AND n.t = f.t GROUP BY f.scene, f.t"""),
    "sensitivity_report": sql(REPORT3),
    "policy_sets": sql('SELECT query_id, scene, "free", occupied, ignored, undetermined FROM sets3'),
    "undetermined_scenes": sql("""
        SELECT query_id, scene FROM (
            (SELECT query_id, scene FROM matches3 WHERE policy = 'free' EXCEPT SELECT query_id, scene FROM matches3 WHERE policy = 'occupied')
            UNION ALL
            (SELECT query_id, scene FROM matches3 WHERE policy = 'occupied' EXCEPT SELECT query_id, scene FROM matches3 WHERE policy = 'free'))"""),
    "unknown_stable": sql("""
        SELECT query_id, count_if(undetermined) = 0 AS stable, count_if(undetermined) AS undetermined FROM sets3 GROUP BY query_id"""),
    "outcome_lists": sql("""
        SELECT query_id, policy, scene, CASE WHEN bool_or(g) THEN 'fp' ELSE 'fn' END AS outcome FROM (
            SELECT query_id, policy, scene, true AS g FROM got4
            UNION ALL
            SELECT query_id, policy, scene, false FROM truth , (VALUES ('free'), ('occupied'), ('ignored')) AS q(policy))
        GROUP BY query_id, policy, scene HAVING count(*) = 1"""),
    "precision_recall_f1": sql(f"""
        SELECT query_id, tp, fp, fn, {SCORES} FROM ({counts(
            "matches4",
            f"(SELECT query_id, 'free' AS policy FROM {ALL_QUERIES} AS q(query_id))")}) AS c"""),
    "baseline_report": sql(BASELINE4),
    "full_report": sql(FULL_REPORT),
    "expressibility_coverage": sql(f"""
        SELECT count(*) AS queries, count(*) AS occupancy_expressible, count_if(query_id = '{Q4}') AS box_expressible
        FROM (SELECT DISTINCT query_id FROM truth )"""),
    "match_matrix": sql(f"""
        SELECT f.scene, """ + ", ".join(
        f"bool_or(coalesce(m.query_id = '{q}', false)) AS {q}" for q in (Q1, Q2, Q3, Q4)) + """
        FROM (SELECT DISTINCT scene FROM frames ) AS f LEFT JOIN matches4 AS m ON m.scene = f.scene AND m.policy = 'free' GROUP BY f.scene"""),
    "mask_variants": " UNION ALL ".join(
        f"SELECT query_id, policy, scene, '{m}' AS mask FROM ({masked_matches(m)})" for m in ("none", "lidar", "camera")),
    "clearance_agreement": sql("""
        SELECT count_if(a IS NOT NULL AND b IS NOT NULL) AS both_finite, count_if(a IS NULL AND b IS NULL) AS both_open,
               count_if((a IS NULL) <> (b IS NULL)) AS one_open, round(avg(abs(a - b)), 6) AS mae,
               count_if(a >= b * 0.75::DOUBLE AND a <= b * 1.25::DOUBLE) AS within_tolerance,
               round(count_if(a >= b * 0.75::DOUBLE AND a <= b * 1.25::DOUBLE) / count(a + b)::DOUBLE, 6) AS tolerance_accuracy
        FROM (SELECT scene, t, max(clearance) FILTER (policy = 'occupied') AS a, max(clearance) FILTER (policy = 'free') AS b
              FROM cheap_fm GROUP BY scene, t)"""),
    "threshold_full_curve": sql(f"""
        SELECT round(threshold, 6) AS threshold, tp, fp, fn, {SCORES} FROM (
            SELECT h.threshold, count_if(want AND b.value < coalesce(h.threshold, 'inf'::DOUBLE)) AS tp,
                   count_if(NOT want AND b.value < coalesce(h.threshold, 'inf'::DOUBLE)) AS fp,
                   count_if(want AND coalesce(b.value >= coalesce(h.threshold, 'inf'::DOUBLE), true)) AS fn
            FROM (SELECT b.value, w.scene IS NOT NULL AS want FROM best b
                  FULL JOIN (SELECT scene FROM truth WHERE query_id = '{Q1}') w ON w.scene = b.scene) b
            CROSS JOIN (SELECT DISTINCT value AS threshold FROM best WHERE value IS NOT NULL UNION ALL SELECT NULL) AS h
            GROUP BY h.threshold)"""),
    "occlusion_ranking": sql("""
        SELECT score, round(sum(hits * upto_hits::DOUBLE / upto) / sum(hits), 6) AS average_precision,
               round(sum(hits) / sum(n)::DOUBLE, 6) AS chance, count(*) AS distinct_values, sum(n) AS rows
        FROM (SELECT score, hits, n, sum(hits) OVER w AS upto_hits, sum(n) OVER w AS upto FROM (
                  SELECT score, value, count_if(NOT observed) AS hits, count(*) AS n FROM ranked
                  UNPIVOT (value FOR score IN (depth, distance, shuffled_depth, matched_depth)) GROUP BY score, value)
              WINDOW w AS (PARTITION BY score ORDER BY value DESC))
        GROUP BY score"""),
    "threshold_sweep": sql(f"""
        SELECT threshold, tp, fp, fn, {SCORES} FROM (
            SELECT threshold, count_if(got AND want) AS tp, count_if(got AND NOT want) AS fp, count_if(NOT got AND want) AS fn
            FROM (SELECT h.threshold::DOUBLE AS threshold, coalesce(b.value < h.threshold::DOUBLE, false) AS got, w.scene IS NOT NULL AS want
                  FROM (SELECT scene, min(clearance) AS value FROM cheap_fm WHERE policy = 'free' AND speed > 8.33::DOUBLE GROUP BY scene) b
                  FULL JOIN (SELECT scene FROM truth WHERE query_id = '{Q1}') w ON w.scene = b.scene
                  CROSS JOIN (VALUES (0.1), (0.3), (0.5), (1.0), (1.5), (2.0), (3.0)) AS h(threshold))
            GROUP BY threshold)"""),
}
