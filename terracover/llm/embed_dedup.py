"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells.

Only vectors of one label are compared. Equal vectors are first folded into one with a weight. Centroids
are fitted on at most `fit_rows` vectors (chosen by a hash of the vector); every vector is assigned. Their
number grows with the largest label, up to `max_cells`, which bounds what is broadcast.
A vector is at home in the cell of its nearest centroid and is sent to each further cell in which a
vector within the threshold could be at home: x at home in a means x.a >= x.c for all c, and |x - y| is
at most d = sqrt(2 - 2 * least), so y.a >= y.c - d |a - c| for all c; and y is within the link's angle of a
vector of the cell, so no farther from its centroid than the cell's farthest vector and that angle. No link
is lost. Of two cells only one gets the other's vectors, so that a pair meets once, and one product decides for both its ends.

Cells larger than `block` are dealt out in block x block pieces. A piece counts links per vector and
sends on a spanning forest of its links, never all pairs. The least vec_id of a group is kept.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, rows with a
null label and rows with a null vec_id link with nothing and are their own group; vectors of different
length never link; repeated rows count as vectors of their own (they link with each other), but share
their group's vec_id; rows of one vec_id with other labels or vectors are told apart; vectors are scaled
before their length is taken, so that no finite one is too large or too small; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracover.llm.common import components, stored

#: Cosines this near to the threshold are summed again in one fixed order; dots that are held at once.
CLOSE, PAIRS = 1e-12, 1 << 22


def _unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of the unit rows x; starts from evenly spaced rows, empty cells keep theirs."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return np.unique(c, axis=0)


def _typed(vectors: DataFrame) -> DataFrame:
    """vec_id, label, e (in the table's own precision) and good: whether the vector may link."""
    kind = dict(vectors.dtypes)["embedding"]
    e = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), e.alias("e"))
    e = F.col("e")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0)
    return out.withColumn("good", F.coalesce(good, F.lit(False)))


def _nearest(c: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Where a stretch of unit vectors begins, and its dots with all centroids; PAIRS of them at most at once."""
    rows = max(1, PAIRS // len(c))
    for k in range(0, len(x), rows):
        yield k, x[k : k + rows] @ c.T


def _homes(shared):
    """struct<cells, dot>: the home cell of each vector (several if nearly tied, as rounding may decide otherwise later) and its dot with the centroid."""

    def homes(e: pd.Series) -> pd.DataFrame:
        cells, dot, size = np.empty(len(e), object), np.ones(len(e)), e.map(len).to_numpy()
        for dim in np.unique(size):
            at = np.flatnonzero(size == dim)
            c = shared.value.get(int(dim))
            if c is None:  # a length that the sample does not hold: one cell
                for i in at.tolist():
                    cells[i] = [0]
                continue
            for k, dots in _nearest(c, _unit(e.iloc[at])):
                best = dots.max(axis=1)
                i, j = np.nonzero(dots >= best[:, None] - 1e-9)
                for row, own in zip(at[k : k + len(best)].tolist(), np.split(j, np.searchsorted(i, np.arange(1, len(best)))), strict=True):
                    cells[row] = own.tolist()
                dot[at[k : k + len(best)]] = best
        return pd.DataFrame({"cells": cells, "dot": dot})

    homes.__annotations__ = {"e": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(homes, "cells array<int>, dot double")


def sent_to(x: np.ndarray, c: np.ndarray, low: np.ndarray, reach: float) -> Iterator[list[int]]:
    """For each unit vector its home cell, then the further cells that may hold a vector within `reach` of it.

    A cell's vectors lie within an angle of its centroid (low: the cosine of that and the link's angle
    together), and nearer to its centroid than to any other, of which the vector's own nearest are tried.
    Of two cells, one sends its vectors to the other.
    """
    for _, dots in _nearest(c, x):
        home = dots.argmax(axis=1)
        best = np.argpartition(-dots, min(8, len(c)) - 1, axis=1)[:, :8]
        i, k = np.nonzero(dots >= low)
        some = (k != home[i]) & ((k < home[i]) == ((k + home[i]) % 2 == 0))
        i, k = i[some], k[some]
        for b in best.T:
            keep = np.empty(len(i), bool)
            for s in range(0, len(i), PAIRS // 64):
                part = slice(s, s + PAIRS // 64)
                ii, kk = i[part], k[part]
                bb = b[ii]
                gap = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", c[kk], c[bb])))
                keep[part] = dots[ii, kk] >= dots[ii, bb] - gap * reach - 1e-9
            i, k = i[keep], k[keep]
        cuts = np.searchsorted(i, np.arange(len(dots) + 1)).tolist()
        others = k.tolist()
        yield from ([h, *others[a:z]] for h, a, z in zip(home.tolist(), cuts, cuts[1:], strict=False))


def _cells(shared, reach: float):
    """The home cell of each vector, then the further cells to which it is sent."""

    def cells(e: pd.Series) -> pd.Series:
        out = np.empty(len(e), object)
        size = e.map(len).to_numpy()
        for dim in np.unique(size):
            at = np.flatnonzero(size == dim)
            c, low = shared.value.get(int(dim), (None, None))
            rows = [[0]] * len(at) if c is None else sent_to(_unit(e.iloc[at]), c, low, reach)
            for i, row in zip(at.tolist(), rows, strict=True):
                out[i] = row
        return pd.Series(out)

    cells.__annotations__ = {"e": pd.Series, "return": pd.Series}
    return F.pandas_udf(cells, "array<int>")


def _pieces(sent: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Rows of sent dealt to pieces (keys, i, j) with a role: 1 row side, 2 column side, 3 both.

    Vectors at home are cut into ni blocks and meet each other in the pieces i <= j < ni; vectors sent to
    the cell are cut into nk blocks, which all blocks at home meet. One block at home meets the first
    block of those in the same piece in which it meets itself.
    """
    size = sent.groupBy(keys).agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("p")).where("h > 0 and h + p > 1")
    parts = lambda c: F.ceil(F.col(c) / block).cast("int")
    dealt = sent.join(size.select(*keys, parts("h").alias("ni"), parts("p").alias("nk")), keys)
    ni, nk, x = F.col("ni"), F.col("nk"), F.xxhash64("key")
    own, at = F.pmod(x, ni).cast("int"), F.when(nk > 0, F.pmod(x, nk)).cast("int")
    piece = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), role.alias("role"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: k < n)
    role = lambda j: F.when(j == own, 3).when(j > own, 1).otherwise(2)
    among = F.transform(upto(ni), lambda j: piece(F.least(own, j), F.greatest(own, j), role(j)))
    first = F.when(ni == 1, F.lit(0)).otherwise(ni)  # where the blocks of vectors sent here begin
    with_sent = F.transform(F.filter(upto(nk), lambda k: first + k > 0), lambda k: piece(own, first + k, F.lit(1)))
    as_sent = F.transform(upto(ni), lambda i: piece(i, first + at, F.lit(2)))
    return dealt.select(*keys, "key", "w", "e", F.inline(F.when(F.col("home"), F.concat(among, with_sent)).otherwise(as_sent)))


def _compare(least: float, rows: int = 512):
    """Links of one piece: (key, n, root), n the links' weight and root the least key reached within the piece."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("key")
        role = b["role"].to_numpy()
        a, c = b[role != 2], pd.concat([b[role == 3], b[role == 2]])
        own = int((role == 3).sum())
        if not len(a) or not len(c):
            return pd.DataFrame({"key": [], "n": [], "root": []})
        xa, xc = _unit(a["e"]), _unit(c["e"])
        hit = np.empty((len(a), len(c)), bool)
        for k in range(0, len(a), rows):
            s = xa[k : k + rows] @ xc.T
            for i, j in zip(*np.nonzero(np.abs(s - least) <= CLOSE), strict=True):
                s[i, j] = (xa[k + i] * xc[j]).sum()
            hit[k : k + rows] = s >= least
        if own:
            hit[:, :own] &= np.arange(len(a))[:, None] < np.arange(own)[None]  # a pair of one block once
        ia, ic = a["key"].to_numpy(), c["key"].to_numpy()
        na, nc = hit @ c["w"].to_numpy(), a["w"].to_numpy() @ hit
        ra, rc = np.flatnonzero(na), np.flatnonzero(nc)
        hit = hit[np.ix_(ra, rc)]
        both, where = np.unique(np.r_[ia[ra], ic[rc]], return_inverse=True)
        wa, wc = where[: len(ra)], where[len(ra) :]
        label, big = np.arange(len(both)), len(both)
        while len(both):
            old = label.copy()
            np.minimum.at(label, wa, np.where(hit, label[wc][None], big).min(axis=1))
            np.minimum.at(label, wc, np.where(hit, label[wa][:, None], big).min(axis=0))
            if (label == old).all():
                break
        n = np.bincount(wa, na[ra], len(both)) + np.bincount(wc, nc[rc], len(both))
        return pd.DataFrame({"key": both, "n": n.astype(np.int64), "root": both[label]})

    return run


def links(vectors: DataFrame, least: float = 0.98, fit_rows: int = 20_000, cell_rows: int = 4096, max_cells: int = 4096, block: int = 4096) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Valid rows (vec_id, k1, k2), folded vectors (k1, k2, key, id, w, label, e) and their links (key, n, root)."""
    valid = _typed(vectors).where("good")
    keyed = valid.select("vec_id", "label", "e", F.xxhash64("label", "e").alias("k1"), F.xxhash64("e", "label").alias("k2"))
    folded = keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("w"), F.first("label").alias("label"), F.first("e").alias("e"))
    folded = stored(folded.withColumn("key", F.monotonically_increasing_id()), "vectors")
    most = folded.groupBy("label", F.size("e").alias("dim")).count().agg(F.max("count")).first()[0] or 0
    sample = folded.select("k1", "e").orderBy("k1").limit(fit_rows).toPandas()
    centroids = {}
    for dim, part in sample.groupby(sample["e"].map(len)) if len(sample) else ():
        x = _unit(part["e"])
        centroids[dim] = kmeans(x, max(1, min(max_cells, -(-most // cell_rows), len(x))))
    sc = folded.sparkSession.sparkContext
    homes = folded.select(F.size("e").alias("dim"), _homes(sc.broadcast(centroids))("e").alias("h"))
    angle, bounds = math.acos(min(1.0, max(-1.0, least))), {d: np.full(len(c), 2.0) for d, c in centroids.items()}  # 2: no vector, none is sent
    for r in homes.select("dim", F.explode("h.cells").alias("cell"), "h.dot").groupBy("dim", "cell").agg(F.min("dot").alias("dot")).collect():
        if r["dim"] in bounds:
            bounds[r["dim"]][r["cell"]] = math.cos(min(math.pi, math.acos(min(1.0, max(-1.0, r["dot"]))) + angle)) - 1e-8
    found = _cells(sc.broadcast({d: (c, bounds[d]) for d, c in centroids.items()}), math.sqrt(max(0.0, 2 - 2 * least)))(F.col("e"))
    sent = folded.select("key", "w", "label", F.size("e").alias("dim"), "e", F.posexplode(found).alias("at", "cell")).withColumn("home", F.col("at") == 0).drop("at")
    keys = ["label", "dim", "cell"]
    out = _pieces(sent, keys, block).groupBy(*keys, "i", "j").applyInPandas(_compare(least), "key long, n long, root long")
    return keyed.select("vec_id", "k1", "k2"), folded, stored(out, "links")


def near_duplicates(vectors: DataFrame, least: float = 0.98, **options) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    keyed, folded, found = links(vectors, least, **options)
    counts = found.groupBy("key").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("key").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("key"), "root")
    known = folded.select("k1", "k2", "key", "id", "w").join(counts, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    known = stored(known, "known")
    named = stored(known.groupBy("root").agg(F.min("id").alias("component_id")), "named")  # so that both sides are bare exchanges: a large root is split
    known = known.join(named, "root").select("k1", "k2", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    known = stored(known, "components")  # the same for a vector with many copies
    linked = keyed.join(known, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = _typed(vectors).where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
