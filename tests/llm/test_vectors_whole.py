"""Embedding links: many cells, repeated ids, vectors of extreme length, copies sent only once a pair."""

import numpy as np
import pytest

from terracover.llm import embed_dedup

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    """(n_links, component_id) of every row, by comparing all rows."""
    unit = []
    for _, e, _ in rows:
        v = np.array(e, float)
        v = v / np.abs(v).max()
        unit.append(v / np.sqrt((v * v).sum()))
    n, root = len(rows), list(range(len(rows)))
    links = [0] * n
    for i in range(n):
        for j in range(i):
            if rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and (unit[i] * unit[j]).sum() >= 0.98:
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], least[root[i]], rows[i][0] == least[root[i]]) for i in range(n))


@pytest.mark.parametrize("block", [8, 4096])
def test_many_cells(spark, block):
    """One label, about twenty cells, neighbours on both sides of their borders."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(150, 6))
    rows = [(k, (base[k % 150] + rng.normal(0, 0.12, 6)).tolist(), k % 7 // 6) for k in range(450)]
    rows += [(1000 + k, rows[k][1], rows[k][2]) for k in range(0, 450, 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, embed_dedup.near_duplicates(df, block=block, cell_rows=20).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == brute(rows) and max(g[1] for g in got) > 3


def test_repeated_ids_are_told_apart(spark):
    a, b = [1.0, 0.0, 0.0], [0.999, 0.01, 0.0]
    rows = [(1, a, 0), (2, b, 0), (1, a, 1), (3, b, 1), (1, [0.0, 1.0, 0.0], 0), (4, [0.0, 1.0, 0.01], 0)]
    got = sorted(map(tuple, embed_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == brute(rows) == [(1, 1, 1, True)] * 3 + [(2, 1, 1, False), (3, 1, 1, False), (4, 1, 1, False)]


def test_vectors_of_any_length_link(spark):
    rows = [(1, [1e300, 1e300], 0), (2, [1e-300, 1e-300], 0), (3, [5e-324, 5e-324], 0), (4, [1.7e308, 0.0], 0), (5, [-1e-320, 0.0], 0), (6, [3.0, 3.0], 0)]
    got = sorted(map(tuple, embed_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == brute(rows) and [g[1] for g in got] == [3, 3, 3, 0, 0, 3]


def test_thousands_of_cells_in_bounded_memory():
    """4,096 cells of structureless vectors: few copies, no neighbour's cell left out, little memory; in a process of its own."""
    import subprocess
    import sys

    code = """
import resource, numpy as np
from terracover.llm import embed_dedup as e
rng = np.random.default_rng(1)
x = e._unit(list(rng.normal(size=(8000, 64))))
c = e.kmeans(x[:4096], 4096, 1)
y = e._unit(list(x[:400] + rng.normal(0, 0.012, (400, 64))))
every = np.r_[x, y]
home, best = np.zeros(len(every), int), np.zeros(len(every))
for k, dots in e._nearest(c, every):
    home[k:k + len(dots)], best[k:k + len(dots)] = dots.argmax(1), dots.max(1)
low = np.full(4096, 2.0)
np.minimum.at(low, home, best)
low = np.where(low < 2, np.cos(np.minimum(np.pi, np.arccos(np.clip(low, -1, 1)) + np.arccos(0.98))) - 1e-8, 2.0)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
sent = list(e.sent_to(every, c, low, 0.2))
more = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024
near = (every[:400] * y).sum(1) >= 0.98
assert near.sum() > 300 and [r[0] for r in sent] == home.tolist()
assert all(set(sent[i]) & set(sent[8000 + i]) for i in np.flatnonzero(near).tolist())
assert np.mean([len(r) for r in sent]) < 20 and more < 500, (np.mean([len(r) for r in sent]), more)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-800:]
