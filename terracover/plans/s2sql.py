"""S2 cells in SQL: the twin of the numpy kernel, for DuckDB."""

from __future__ import annotations

from terracover.functions import s2

_POS = "[" + ", ".join(str(int(x)) for x in s2.IJ_TO_POS.ravel()) + "]"
_TURN = "[" + ", ".join(str(int(x)) for x in s2.POS_TO_ORIENTATION) + "]"


def ij(rows: str) -> str:
    """rows (with lat and lon) with the face and the leaf coordinates i and j of the cube."""
    st = lambda u: f"(CASE WHEN {u} >= 0 THEN 0.5*sqrt(1+3*abs({u})) ELSE 1-0.5*sqrt(1+3*abs({u})) END)"
    leaf = lambda u: f"CAST(least(greatest(floor({st(u)}*1073741824.0), 0), 1073741823) AS BIGINT)"
    uv = "CASE face WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} WHEN 4 THEN {4} ELSE {5} END"
    u, v = uv.format("y/x", "-x/y", "-x/z", "z/x", "z/y", "-y/z"), uv.format("z/x", "z/y", "-y/z", "y/x", "-x/y", "-x/z")
    face = "CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN CASE WHEN x < 0 THEN 3 ELSE 0 END WHEN abs(y) >= abs(z) THEN CASE WHEN y < 0 THEN 4 ELSE 1 END ELSE CASE WHEN z < 0 THEN 5 ELSE 2 END END"
    xyz = f"SELECT *, cos(radians(lat))*cos(radians(lon)) AS x, cos(radians(lat))*sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM ({rows})"
    return f"SELECT * EXCLUDE (x, y, z, u, v), {leaf('u')} AS i, {leaf('v')} AS j FROM (SELECT *, {u} AS u, {v} AS v FROM (SELECT *, {face} AS face FROM ({xyz})))"


def cell(level: int, i: str = "i", j: str = "j") -> str:
    """The unsigned id of the cell of a level: the Hilbert curve's steps folded from the top, four bits of state."""
    quads = f"list_transform(range(29, {29 - level}, -1), lambda k: CAST((({i} >> k) & 1) * 2 + (({j} >> k) & 1) AS HUGEINT))"
    orient, pos = "(a % 4)", "(a // 4)"
    step = f"{_POS}[CAST({orient} * 4 + q + 1 AS INT)]"
    folded = f"list_reduce(list_prepend(CAST(face & 1 AS HUGEINT), {quads}), lambda a, q: CAST(({pos} * 4 + {step}) * 4 + xor(CAST({orient} AS INT), {_TURN}[CAST({step} + 1 AS INT)]) AS HUGEINT))"
    shift = 2 * (30 - level)
    return f"(CAST(face AS HUGEINT) * 2305843009213693952 + ({folded} // 4) * {1 << (shift + 1)} + {1 << shift})"


def signed(c: str) -> str:
    """The id as the library's long."""
    return f"CAST(CASE WHEN {c} >= 9223372036854775808 THEN {c} - 18446744073709551616 ELSE {c} END AS BIGINT)"


def block_counts(points: str, level: int, size: int, least: int) -> str:
    """(cell, n): aligned blocks of size x size cells that hold at least `least` of the points, by their centre cell."""
    side = 1 << (30 - level)
    middle = lambda a: f"least({a} * {side * size} + {size // 2 * side}, {(1 << 30) - side})"
    blocks = f"SELECT face, i // {side * size} AS bi, j // {side * size} AS bj, count(*) AS n FROM ({ij(points)}) GROUP BY ALL HAVING count(*) >= {least}"
    return f"SELECT {signed(cell(level))} AS cell, n FROM (SELECT face, {middle('bi')} AS i, {middle('bj')} AS j, n FROM ({blocks}))"


def around(points: str, centres: str, level: int, reach: int) -> str:
    """(face, i, j, n) of centre cells and the points in the cells at most `reach` cells away on the same face."""
    side = 1 << (30 - level)
    at = lambda rows: f"SELECT face, i // {side} AS ci, j // {side} AS cj FROM ({ij(rows)})"
    return f"SELECT c.face, c.ci * {side} AS i, c.cj * {side} AS j, count(*) AS n FROM (SELECT DISTINCT * FROM ({at(centres)})) c JOIN ({at(points)}) p ON p.face = c.face AND abs(p.ci - c.ci) <= {reach} AND abs(p.cj - c.cj) <= {reach} GROUP BY ALL"


def corner(i: str, j: str) -> tuple[str, str, str]:
    """Unnormalised x, y, z of a corner of the cube's grid on a face, by its leaf coordinates (up to the face's far edge)."""
    uv = lambda s: f"(CASE WHEN {s} >= 0.5 THEN (4*{s}*{s}-1)/3 ELSE (1-4*(1-{s})*(1-{s}))/3 END)"
    u, v = uv(f"(({i})/1073741824.0)"), uv(f"(({j})/1073741824.0)")
    by = lambda *c: "CASE face " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(c)) + " END"
    return by("1.0", f"-{u}", f"-{u}", "-1.0", v, v), by(u, "1.0", f"-{v}", f"-{v}", "-1.0", u), by(v, v, "1.0", f"-{u}", f"-{u}", "-1.0")


def corners(cells: str, level: int, keep: str) -> str:
    """keep, k and lat, lon of the four corners of cells (face, ci, cj) of a level."""
    side = 1 << (30 - level)
    one = "SELECT {0}, {1} AS k, {2} AS x, {3} AS y, {4} AS z FROM ({5})"
    rows = [one.format(keep, k, *corner(f"(ci + {a}) * {side}", f"(cj + {b}) * {side}"), cells) for k, (a, b) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))]
    return f"SELECT {keep}, k, degrees(atan2(z, sqrt(x*x+y*y))) AS lat, degrees(atan2(y, x)) AS lon, x, y, z FROM ({' UNION ALL '.join(rows)})"


def domain(points: str, level: int, margin: int) -> str:
    """(face, ci, cj): the cells of a level in the bounds of the points on each face, and `margin` cells around them on that face."""
    side, most = 1 << (30 - level), (1 << level) - 1
    span = lambda c: f"generate_series(greatest(min({c} // {side}) - {margin}, 0), least(max({c} // {side}) + {margin}, {most}))"
    return f"SELECT face, ci, unnest(js) AS cj FROM (SELECT face, unnest({span('i')}) AS ci, {span('j')} AS js FROM ({ij(points)}) GROUP BY face)"


def steps_around(points: str, centres: str, level: int, reach: int) -> str:
    """(cell, n): centre cells and the points within `reach` steps between cells that share a corner, wherever on the cube."""
    side = 1 << (30 - level)
    at = lambda rows: f"SELECT face, i // {side} AS ci, j // {side} AS cj FROM ({ij(rows)})"
    place = lambda c: f"CAST(round({c} / sqrt(x*x+y*y+z*z) * 1e9) AS BIGINT)"
    return (
        f"WITH RECURSIVE dom AS ({domain(f'SELECT lat, lon FROM ({points}) UNION ALL SELECT lat, lon FROM ({centres})', level, reach + 1)}), "
        f"spot AS (SELECT DISTINCT face, ci, cj, {place('x')} AS px, {place('y')} AS py, {place('z')} AS pz FROM ({corners('SELECT * FROM dom', level, 'face, ci, cj')})), "
        "beside AS (SELECT DISTINCT a.face, a.ci, a.cj, b.face AS f2, b.ci AS ci2, b.cj AS cj2 FROM spot a JOIN spot b USING (px, py, pz)), "
        f"walk AS (SELECT DISTINCT face AS f0, ci AS ci0, cj AS cj0, face, ci, cj, 0 AS n FROM ({at(centres)}) UNION SELECT f0, ci0, cj0, f2, ci2, cj2, n + 1 FROM walk JOIN beside USING (face, ci, cj) WHERE n < {reach}), "
        "near AS (SELECT DISTINCT f0, ci0, cj0, face, ci, cj FROM walk) "
        f"SELECT {signed(cell(level, f'(ci * {side})', f'(cj * {side})'))} AS cell, n FROM (SELECT f0 AS face, ci0 AS ci, cj0 AS cj, count(*) AS n FROM near JOIN ({at(points)}) p USING (face, ci, cj) GROUP BY f0, ci0, cj0)"
    )
