"""Known values and invariants of the numeric kernels."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terracover.functions import geo, geohash, names, s2
from terracover.operators import bootstrap, cover, formats, plugins, routing

RNG = np.random.default_rng(7)


def test_known_distances_and_geohash(spark):
    df = spark.range(1).select(
        F.round(geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), 2).alias("d"), geohash.encode(F.lit(57.64911), F.lit(10.40744), 11).alias("g"), geohash.encode(F.lit(91.0), F.lit(0.0), 5).alias("bad")
    )
    r = df.first()
    assert (r.d, r.g, r.bad) == (111195.08, "u4pruydqqvj", None)


def test_s2_round_trips():
    lat, lon = np.degrees(np.arcsin(RNG.uniform(-1, 1, 500))), RNG.uniform(-180, 180, 500)
    assert s2.cell_ids(np.array([0.0]), np.array([0.0]))[0] == 1152921504606846977
    for level in (0, 7, 20, 30):
        c = s2.cell_ids(lat, lon, level)
        y, x = s2.centers(c)
        assert (s2.cell_ids(y, x, level) == c).all() and (s2.level_of(c) == level).all()
        assert (s2.parent(s2.cell_ids(lat, lon), level) == c).all()
    assert f"{int(s2.cell_ids(np.array([40.7128]), np.array([-74.006]), 12).view(np.uint64)[0]):x}" == "89c25a3000000000"
    assert len(s2.neighbourhood(int(s2.cell_ids(np.array([40.0]), np.array([-74.0]), 15)[0]), 5)) == 25


def _points(n, spread=0.01, seed=1):
    rng = np.random.default_rng(seed)
    return 40 + rng.random(n) * spread, -74 + rng.random(n) * spread


@pytest.mark.parametrize("min_points", [1, 3])
def test_greedy_invariants(min_points):
    lat, lon = _points(600)
    y, x = cover.cover_group(lat, lon, 70.0, min_points, "fast", density=64)
    d = cover.metres_between(lat[:, None], lon[:, None], y[None], x[None]) <= 70.0
    if min_points == 1:
        assert d.any(axis=1).all()
    else:
        own = d & (d.sum(axis=1, keepdims=True) == 1)
        assert len(y) and (d.sum(axis=0) >= min_points).all() and own.any()
    few, _ = cover.cover_group(lat, lon, 70.0, 3, "fast", max_clusters=5, density=64)
    assert len(few) <= 5


def test_greedy_matches_pass_by_pass():
    """Lazy evaluation gives the order of always re-counting everything."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        n, k = 40, 25
        sets = [np.flatnonzero(rng.random(n) < 0.15) for _ in range(k)]
        ptr, members = np.r_[0, np.cumsum([len(x) for x in sets])], np.concatenate(sets)
        got = cover.greedy(ptr, members, np.arange(n), 1)
        left, want = set(range(n)), []
        while True:
            best = max(range(k), key=lambda c: (len(left & set(sets[c])), len(sets[c]), -c))
            if not left & set(sets[best]):
                break
            want.append(best)
            left -= set(sets[best])
        assert got == cover._pruned(want, ptr, members, np.arange(n), 1)


def test_disc_members_brute_force():
    lat, lon = _points(300)
    y, x = _points(50, seed=2)
    ptr, at = cover.disc_members(y, x, lat, lon, 150.0)
    d = cover.metres_between(lat[None], lon[None], y[:, None], x[:, None]) <= 150.0
    for c in range(50):
        assert sorted(at[ptr[c] : ptr[c + 1]]) == np.flatnonzero(d[c]).tolist()


def test_unit_disc_cover_covers():
    lat, lon = _points(500)
    y, x = cover.unit_disc_cover(lat, lon, 70.0, 1)
    d = cover.metres_between(lat[:, None], lon[:, None], y[None], x[None])
    assert (d.min(axis=1) <= 70.5).all()


def test_enclosing_disc():
    lat, lon = _points(6, spread=0.0005)
    got = cover.enclosing(lat, lon, 70.0)
    assert got and (cover.metres_between(lat, lon, *got) <= 70.0).all()
    assert cover.enclosing(np.array([40.0, 41.0]), np.array([-74.0, -74.0]), 70.0) is None


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 60), st.integers(0, 1000))
def test_tour_is_a_permutation(n, seed):
    lat, lon = _points(n, seed=seed)
    order = routing.tour_order(lat, lon)
    assert sorted(order) == list(range(n)) and order[0] == 0


def test_tour_beats_input_order():
    lat, lon = _points(200)
    length = lambda o: cover.metres_between(lat[o], lon[o], lat[np.roll(o, -1)], lon[np.roll(o, -1)]).sum()
    assert length(routing.tour_order(lat, lon)) < 0.3 * length(np.arange(200))


def test_lattice_spacing():
    p = bootstrap.lattice(-74.0, 40.0, -73.98, 40.01, 70.0)
    d = cover.metres_between(p[:-1, 0], p[:-1, 1], p[1:, 0], p[1:, 1])
    assert abs(np.median(d) - np.sqrt(0.75) * 140) < 0.5


def test_name_modifier_examples(spark):
    m = lambda text, **o: spark.range(1).select(names.modify(F.lit(text), F.lit("Parent"), **o).alias("x")).first().x
    assert m("abcdef", trimstart=2) == "cdef" and m("abcdef", trimend=2) == "abcd"
    assert m("a_b", underscore=" ") == "a b" and m("Zażółć", unpolish=True) == "Zazolc"
    assert m("Test", lowercase=False) == "test" and m("abc", trimstart=9) == "abc"
    assert m("new york", capitalize=" ") == "New York" and m("x", parentstart="-") == "Parent-x"
    assert m("My Parent Parent", parentreplace="Up") == "My Up Parent"


def test_formats():
    assert formats.sniff("1,2") == "text" and formats.sniff([[1, 2]]) == "single_array" and formats.sniff([[[1, 2]]]) == "multi_array"
    assert formats.sniff({"type": "Feature"}) == "feature" and formats.sniff([{"lat": 1, "lon": 2}]) == "single_struct"
    for doc in ("1,2\n3,4\n5,6", "1 2,3 4,5 6", [[1, 2], [3, 4], [5, 6]], [{"lat": 1, "lon": 2}, {"lat": 3, "lon": 4}, {"lat": 5, "lon": 6}]):
        assert formats.to_features(doc)[0]["geometry"]["coordinates"] == [[[2, 1], [4, 3], [6, 5], [2, 1]]]
    assert formats.return_type("Feature-Collection", "text") == "feature_collection" and formats.return_type("array", "multi_array") == "multi_array"
    assert formats._rdp([(0, 0), (0, 1), (0.00001, 2), (0, 3), (3, 3)], 1e-4) == [[0, 0], [0, 3], [3, 3]]


def test_plugin_codec(spark):
    assert plugins.command("a.py", "--x 1", radius=70) == ["python3", "a.py", "--x", "1", "--radius", "70"]
    assert plugins.command("a.py", "python3.11 --x 1") == ["python3.11", "a.py", "--x", "1"]
    assert len(plugins.decode("1,2 3,4\n1,2")) == 2
    with pytest.raises(ValueError):
        plugins.decode("nothing")


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "fid long, lat double, lon double")
    assert cover.greedy_cover(none, 70.0).count() == 0 and cover.fastest_cover(none, 70.0).count() == 0
