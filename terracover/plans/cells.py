"""Queries on S2 cells: boxes, outlines and blocks, at edges and corners of the cube too."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracover.functions import s2
from terracover.operators import cover
from terracover.plans import s2sql
from terracover.plans.registry import Views, query

LEVEL, REACH = 15, 2
_BOXES = "SELECT fid, y0 AS lat, x0 AS lon FROM fence UNION ALL SELECT fid, y1, x1 FROM fence"
_OUTLINES = f"SELECT face, ci, cj, min(lat) AS low, max(lat) AS high, min(lon) AS west, max(lon) AS east FROM ({s2sql.corners(s2sql.domain(_BOXES, 16, 3), 16, 'face, ci, cj')}) GROUP BY face, ci, cj"


@query("fence", f"SELECT fid, {s2sql.signed(s2sql.cell(16, '(ci * 16384)', '(cj * 16384)'))} AS cell FROM (SELECT f.fid, face, ci, cj FROM fence f JOIN ({_OUTLINES}) o ON high >= y0 AND low <= y1 AND east >= x0 AND west <= x1)")
def q_s2_cover_boxes(v: Views):
    """The cells that meet each fence's bounds."""
    return v.fence.select("fid", F.explode(s2.cells_in_box(F.col("y0"), F.col("x0"), F.col("y1"), F.col("x1"), 16)).alias("cell"))


_GYM_CELLS = "SELECT DISTINCT face, i // 32768 AS ci, j // 32768 AS cj FROM ({0})"


def _outlines(v: Views, points: str):
    ids = getattr(v, points).select(s2.cell(F.col("lat"), F.col("lon"), LEVEL).alias("cell")).distinct()
    one = ids.select("cell", F.posexplode(s2.corners(F.col("cell"))).alias("k", "at"))
    return one.select("cell", "k", F.round(F.col("at")[0], 7).alias("lat"), F.round(F.col("at")[1], 7).alias("lon"))


def _outlines_sql(points: str) -> str:
    cells = _GYM_CELLS.format(s2sql.ij(f"SELECT * FROM {points}"))
    own = s2sql.signed(s2sql.cell(LEVEL, "(ci * 32768)", "(cj * 32768)"))
    return f"SELECT {own} AS cell, k, lat, lon FROM (SELECT face, ci, cj, CAST(k AS INT) AS k, round(lat, 7) AS lat, round(lon, 7) AS lon FROM ({s2sql.corners(cells, LEVEL, 'face, ci, cj')}))"


@query("gym", _outlines_sql("gym"))
def q_s2_outlines(v: Views):
    """The corners of the gyms' cells."""
    return _outlines(v, "gym")


@query("edge_gym", _outlines_sql("edge_gym"))
def q_s2_outlines_edge(v: Views):
    return _outlines(v, "edge_gym")


def _blocks(v: Views, points: str, centres: str):
    ids = getattr(v, centres).select(s2.cell(F.col("lat"), F.col("lon"), LEVEL).alias("cell"))
    return cover.s2_block_cover(getattr(v, points), ids, LEVEL, 2 * REACH + 1, 1)


@query("edge_stop edge_gym", f"SELECT cell, n FROM ({s2sql.steps_around('SELECT * FROM edge_stop', 'SELECT * FROM edge_gym', LEVEL, REACH)})")
def q_s2_blocks_edge(v: Views):
    """Points in the blocks around cells next to an edge of the cube, on both its faces."""
    return _blocks(v, "edge_stop", "edge_gym")


@query("corner_stop corner_gym", f"SELECT cell, n FROM ({s2sql.steps_around('SELECT * FROM corner_stop', 'SELECT * FROM corner_gym', LEVEL, REACH)})")
def q_s2_blocks_corner(v: Views):
    """The same at a corner, where three faces meet and blocks have fewer cells."""
    return _blocks(v, "corner_stop", "corner_gym")
