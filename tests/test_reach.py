"""Dense groups: which cells a disc reaches is settled without counting its points."""

import numpy as np

from terracover.operators import cover


def _dense(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(3)
    return 40 + rng.random(n) * 0.003, -74 + rng.random(n) * 0.003


def test_reached_cells_are_those_of_all_points():
    lat, lon = _dense(30_000)
    whole = cover.Raster.of(lat, lon, 70.0)
    few = whole.exposed()
    assert few.table is not None and len(few.lat) < len(lat) / 2
    rng = np.random.default_rng(4)
    y, x = 39.9995 + rng.random(3000) * 0.004, -74.0005 + rng.random(3000) * 0.004
    for a, b in zip(whole.discs(y, x), few.discs(y, x, counted=False), strict=True):
        assert all((v == w).all() for v, w in zip(a[:4], b[:4], strict=True))


def test_points_are_counted_only_for_candidates_that_tie(monkeypatch):
    lat, lon = _dense(30_000)
    counted, discs = [], cover.Raster.discs

    def seen(self, y, x, **more):
        counted.append(len(y) * more.get("counted", True))
        return discs(self, y, x, **more)

    monkeypatch.setattr(cover.Raster, "discs", seen)
    cy, _ = cover.cover_group(lat, lon, 70.0, 3, "fast", density=128)
    assert len(cy) and sum(counted) < 128 * 128 / 4


def test_cells_of_the_tree_look_only_at_what_is_unsure_above_them(monkeypatch):
    lat, lon = _dense(6_000)
    looked, discs = [], cover.Raster.discs

    def seen(self, y, x, **more):
        looked.append(len(y))
        return discs(self, y, x, **more)

    whole = cover.Raster.of(lat, lon, 70.0, cover.HALF_CELL / 2**cover.IDENTITY_LEVEL)
    monkeypatch.setattr(cover.Raster, "discs", seen)
    cy, cx = whole.widest(3, 3)
    monkeypatch.undo()
    assert len(cy) and sum(looked) < 20_000
    # no place of a fine grid covers more cells than the first disc
    y, x = (v.ravel() for v in np.meshgrid(np.linspace(40, 40.003, 150), np.linspace(-74, -73.997, 150)))
    most = lambda y, x: max(int(np.bitwise_count(part[3]).sum(axis=1).max()) for part in whole.discs(y, x))
    assert most(y, x) <= most(cy[:1], cx[:1])


def test_every_mode_is_named_once_in_jobs_of_all_modes():
    from terracover import engine

    assert sorted(engine.SLOWEST_FIRST) == sorted(engine.CLUSTER_MODES)
