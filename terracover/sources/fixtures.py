"""Deterministic geo views over the driver's tables, one SQL text for Spark and DuckDB.

Integer arithmetic first, then doubles: points lie on even micro-degrees, fence corners on odd ones.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NOW = 1_704_067_200


def _point(key: str, a: int, b: int) -> str:
    m = "CAST(2 AS DOUBLE)/CAST(1000000 AS DOUBLE)"
    return f"CAST(40 AS DOUBLE) + CAST(({key}*{a}) % 20011 AS DOUBLE)*{m} AS lat, CAST(-74 AS DOUBLE) + CAST(({key}*{b}) % 20021 AS DOUBLE)*{m} AS lon"


def _corner(index: str, offset: int, base: int) -> str:
    return f"CAST({base} AS DOUBLE)+(CAST({index} AS DOUBLE)*CAST(8000 AS DOUBLE)+CAST({offset} AS DOUBLE))/CAST(1000000 AS DOUBLE)"


def _micro(n: int) -> str:
    return f"CAST({n} AS DOUBLE)/CAST(1000000 AS DOUBLE)"


_COL, _ROW = "n_nationkey%5", "(n_nationkey-n_nationkey%5)/5"
_INSET = "CAST(2600 AS DOUBLE)/CAST(1000000 AS DOUBLE)"
_PROPERTY = "(1,'name','database',NULL),(2,'color','color','#ffffff'),(3,'priority','number','5'),(4,'active','boolean','true'),(5,'tags','array','[]'),(6,'meta','object','{}'),(7,'parent','string',NULL)"

#: View name -> SQL over tables and earlier views.
VIEWS: dict[str, str] = {
    "spawnpoint": f"SELECT event_id AS id, {_point('event_id', 7919, 104729)}, :epoch AS last_seen, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 3600 AS INT) END AS despawn_sec FROM events",
# as many points to a disc at any size
    "wide": "SELECT event_id AS id, CAST(0 AS BIGINT) AS fid, CAST(40 AS DOUBLE) + CAST((event_id*7919) % 20011 AS DOUBLE)/CAST(100000 AS DOUBLE)*side AS lat, CAST(-74 AS DOUBLE) + CAST((event_id*104729) % 20021 AS DOUBLE)/CAST(100000 AS DOUBLE)*side AS lon FROM events CROSS JOIN (SELECT sqrt(CAST(count(*) AS DOUBLE)/CAST(100000 AS DOUBLE)) AS side FROM events) AS n",
    "gym": f"SELECT concat('g', CAST(s_suppkey AS :string)) AS id, {_point('s_suppkey', 6661, 15013)}, s_name AS name, s_suppkey*1000 AS updated, CASE WHEN s_suppkey%10<>0 THEN 1 ELSE 0 END AS enabled, CASE WHEN s_suppkey%17=0 THEN 1 ELSE 0 END AS deleted FROM supplier",
    "pokestop": f"SELECT concat('p', CAST(p_partkey AS :string)) AS id, p_partkey AS pk, {_point('p_partkey', 3571, 7907)}, p_name AS name, p_partkey*1000 AS updated, CASE WHEN p_partkey%11<>0 THEN 1 ELSE 0 END AS enabled, CASE WHEN p_partkey%19=0 THEN 1 ELSE 0 END AS deleted FROM part",
    "station": f"SELECT concat('s', CAST(c_custkey AS :string)) AS id, {_point('c_custkey', 9973, 12289)}, c_name AS name, c_custkey*1000 AS updated, CASE WHEN c_custkey%7=0 THEN 1 ELSE 0 END AS is_inactive, 1700000000+c_custkey*86400 AS end_time FROM customer WHERE c_custkey%5=0",
    "fence": f"SELECT CAST(n_nationkey AS BIGINT) AS fid, n_name AS name, CAST(100 + n_regionkey AS BIGINT) AS parent, {_corner(_COL, 301, -74)} AS x0, {_corner(_COL, 7701, -74)} AS x1, {_corner(_ROW, 301, 40)} AS y0, {_corner(_ROW, 7701, 40)} AS y1 FROM nation",
    "ring": f"SELECT fid, 0 AS ring, x0, y0, x1, y1 FROM fence UNION ALL SELECT fid, 1 AS ring, x0+{_INSET}, y0+{_INSET}, x1-{_INSET}, y1-{_INSET} FROM fence WHERE fid%2=1",
    "edge": "SELECT fid, ring, 0 AS seq, x0 AS ex1, y0 AS ey1, x1 AS ex2, y0 AS ey2 FROM ring UNION ALL SELECT fid, ring, 1, x1, y0, x1, y1 FROM ring UNION ALL SELECT fid, ring, 2, x1, y1, x0, y1 FROM ring UNION ALL SELECT fid, ring, 3, x0, y1, x0, y0 FROM ring",
    # fences of one or two polygons: of every fifth fence the halves beside a gap, each with a hole where fid is odd
    "part_box": f"SELECT fid, 0 AS part, x0, y0, x1, y1 FROM fence WHERE fid%5<>4 UNION ALL SELECT fid, 0, x0, y0, x0+{_micro(3400)}, y1 FROM fence WHERE fid%5=4 UNION ALL SELECT fid, 1, x0+{_micro(4000)}, y0, x1, y1 FROM fence WHERE fid%5=4",
    "part_ring": f"SELECT fid, part, 0 AS ring, x0, y0, x1, y1 FROM part_box UNION ALL SELECT fid, part, 1, x0+{_micro(1000)}, y0+{_micro(1000)}, x1-{_micro(1000)}, y1-{_micro(1000)} FROM part_box WHERE fid%2=1",
    "part_edge": "SELECT fid, part, ring, 0 AS seq, x0 AS ex1, y0 AS ey1, x1 AS ex2, y0 AS ey2 FROM part_ring UNION ALL SELECT fid, part, ring, 1, x1, y0, x1, y1 FROM part_ring UNION ALL SELECT fid, part, ring, 2, x1, y1, x0, y1 FROM part_ring UNION ALL SELECT fid, part, ring, 3, x0, y1, x0, y0 FROM part_ring",
    # shapes of straight angles: an L along the west and south of a fence, a box well inside it, or its outline
    "shape_edge": f"SELECT fid, 0 AS ring, seq, ex1, ey1, ex2, ey2 FROM edge WHERE ring = 0 AND fid%3=2 UNION ALL SELECT fid, 0, seq, CASE WHEN seq IN (0, 3) THEN x0+{_micro(3000)} ELSE x1-{_micro(3000)} END, CASE WHEN seq IN (0, 1) THEN y0+{_micro(3000)} ELSE y1-{_micro(3000)} END, CASE WHEN seq IN (2, 3) THEN x0+{_micro(3000)} ELSE x1-{_micro(3000)} END, CASE WHEN seq IN (0, 3) THEN y0+{_micro(3000)} ELSE y1-{_micro(3000)} END FROM fence, (VALUES (0), (1), (2), (3)) AS k(seq) WHERE fid%3=1 UNION ALL SELECT fid, 0, seq, CASE WHEN seq IN (0, 5) THEN x0 WHEN seq IN (1, 2) THEN x1 ELSE x0+{_micro(1100)} END, CASE WHEN seq IN (0, 1) THEN y0 WHEN seq IN (2, 3) THEN y0+{_micro(1100)} ELSE y1 END, CASE WHEN seq IN (5, 4) THEN x0 WHEN seq IN (0, 1) THEN x1 ELSE x0+{_micro(1100)} END, CASE WHEN seq IN (0, 5) THEN y0 WHEN seq IN (1, 2) THEN y0+{_micro(1100)} ELSE y1 END FROM fence, (VALUES (0), (1), (2), (3), (4), (5)) AS k(seq) WHERE fid%3=0",
    "inner_edge": f"SELECT fid, ring, seq, ex1, ey1, ex2, ey2 FROM edge UNION ALL SELECT fid + 1000, 0, seq, CASE WHEN seq IN (0, 3) THEN x0+{_micro(3200)} ELSE x1-{_micro(3200)} END, CASE WHEN seq IN (0, 1) THEN y0+{_micro(3200)} ELSE y1-{_micro(3200)} END, CASE WHEN seq IN (2, 3) THEN x0+{_micro(3200)} ELSE x1-{_micro(3200)} END, CASE WHEN seq IN (0, 3) THEN y0+{_micro(3200)} ELSE y1-{_micro(3200)} END FROM fence, (VALUES (0), (1), (2), (3)) AS k(seq)",
    "geofence": "SELECT fid AS id, name, parent, CASE WHEN fid%2=0 THEN 'auto_quest' ELSE 'pokemon_iv' END AS mode, CASE WHEN fid%5=4 THEN 'MultiPolygon' ELSE 'Polygon' END AS geo_type FROM fence UNION ALL SELECT CAST(100+r_regionkey AS BIGINT), r_name, CAST(NULL AS BIGINT), 'unset', 'Polygon' FROM region",
    # the same gyms and stops around 45 degrees north on the prime meridian, where two faces of the cube meet, and around a corner of three
    "edge_gym": "SELECT id, lat + CAST(498 AS DOUBLE)/CAST(100 AS DOUBLE) AS lat, lon + CAST(7398 AS DOUBLE)/CAST(100 AS DOUBLE) AS lon FROM gym",
    "edge_stop": "SELECT id, lat + CAST(498 AS DOUBLE)/CAST(100 AS DOUBLE) AS lat, lon + CAST(7398 AS DOUBLE)/CAST(100 AS DOUBLE) AS lon FROM pokestop",
    "corner_gym": "SELECT id, lat - CAST(4756 AS DOUBLE)/CAST(1000 AS DOUBLE) AS lat, lon + CAST(11898 AS DOUBLE)/CAST(100 AS DOUBLE) AS lon FROM gym",
    "corner_stop": "SELECT id, lat - CAST(4756 AS DOUBLE)/CAST(1000 AS DOUBLE) AS lat, lon + CAST(11898 AS DOUBLE)/CAST(100 AS DOUBLE) AS lon FROM pokestop",
    "project": "SELECT CAST(r_regionkey + 1 AS INT) AS id, CASE r_regionkey WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma' ELSE lower(r_name) END AS name, r_regionkey % 3 = 0 AS scanner, CASE WHEN r_regionkey % 2 = 1 THEN CAST(NULL AS :string) ELSE concat('http://', lower(r_name)) END AS api_endpoint FROM region",
    "geofence_project": "SELECT g.id AS geofence_id, p.id AS project_id FROM geofence g CROSS JOIN project p WHERE g.id < 24 AND (g.id + p.id) % 3 = 0",
    "property": f"SELECT * FROM (VALUES {_PROPERTY}) AS t(id, name, category, default_value)",
    "geofence_property": "SELECT g.id AS geofence_id, p.id AS property_id, CASE WHEN (g.id+p.id)%5=0 THEN NULL WHEN p.category='number' THEN CASE WHEN g.id%7=0 THEN 'bad' ELSE CAST(g.id*3 AS :string) END WHEN p.category='boolean' THEN CASE WHEN g.id%7=1 THEN 'maybe' WHEN g.id%2=0 THEN 'true' ELSE 'false' END WHEN p.category='color' THEN concat('#00000', CAST(g.id%10 AS :string)) WHEN p.category='array' THEN concat('[', CAST(g.id AS :string), ']') WHEN p.category='object' THEN concat('{\"k\":', CAST(g.id AS :string), '}') ELSE concat('v', CAST(g.id AS :string)) END AS value FROM geofence g CROSS JOIN property p WHERE g.id < 100 AND (g.id*7 + p.id) % 4 <> 0",
    "stop_in_fence": "SELECT p.id AS id, p.pk, p.lat, p.lon, e.fid FROM pokestop p JOIN edge e ON ((e.ey1 > p.lat) <> (e.ey2 > p.lat)) AND p.lon < (e.ex2-e.ex1)*(p.lat-e.ey1)/(e.ey2-e.ey1)+e.ex1 GROUP BY p.id, p.pk, p.lat, p.lon, e.fid HAVING count(*) % 2 = 1",
    "route_point": "SELECT fid, row_number() OVER (PARTITION BY fid ORDER BY lat DESC, lon DESC, pk) AS seq, lat, lon, pk FROM stop_in_fence",
    "instance": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CASE WHEN n_nationkey%4=0 THEN 'leveling' WHEN n_nationkey%4=1 THEN 'circle_pokemon' WHEN n_nationkey%4=2 THEN 'auto_quest' ELSE 'pokemon_iv' END AS type, concat('40.', CAST(n_nationkey+10 AS :string), ',-74.', CAST(n_nationkey+10 AS :string)) AS data FROM nation",
    "area": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CASE WHEN n_nationkey%5=0 THEN '' ELSE concat('40.', CAST(n_nationkey+10 AS :string), ' -74.25,40.5 -74.5,x y,40.75 -74.75') END AS geofence, CASE WHEN n_nationkey%3=0 THEN NULL ELSE '40.5 -74.5' END AS fort_mode_route, CASE WHEN n_nationkey%2=0 THEN '40.25 -74.25' ELSE '' END AS pokemon_mode_route, CASE WHEN n_nationkey%7=0 THEN '40.75 -74.75' ELSE NULL END AS quest_mode_route FROM nation",
    "route": "SELECT fid AS id, fid AS geofence_id, concat('route ', CAST(fid AS :string)) AS name, CASE WHEN fid%2=0 THEN 'circle_quest' ELSE 'circle_raid' END AS mode, CAST(count(*) AS BIGINT) AS points FROM stop_in_fence GROUP BY fid",
    "cluster": "SELECT id AS cid, lat, lon FROM spawnpoint WHERE id % 50 = 0",
}

_TABLES = "region nation customer supplier part orders lineitem events".split()


def _needs(name: str, found: dict[str, None]) -> dict[str, None]:
    """The views below a view, in order of definition."""
    for word in re.findall(r"\b[a-z_]+\b", VIEWS[name]):
        if word in VIEWS and word != name and word not in found and re.search(rf"\b(FROM|JOIN)\s+{word}\b", VIEWS[name]):
            _needs(word, found)
    found[name] = None
    return found


def with_views(names: str, sql: str, spark_dir: str | None = None) -> str:
    """sql with the named views (and what they need) before it; for DuckDB, or for Spark over a folder."""
    found: dict[str, None] = {}
    for n in names.split():
        _needs(n, found)
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in found)
    text = f"WITH {ctes} {sql}"
    if spark_dir:
        text = text.replace(":string", "STRING").replace(":epoch", "unix_timestamp(ts)")
        return re.sub(r"\b(FROM|JOIN) (" + "|".join(_TABLES) + r")\b", rf"\1 parquet.`{spark_dir}/\2.parquet`", text)
    return text.replace(":string", "VARCHAR").replace(":epoch", "CAST(floor(epoch(ts)) AS BIGINT)")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a DataFrame."""
    return spark.sql(with_views(name, f"SELECT * FROM {name}", sf_dir))
