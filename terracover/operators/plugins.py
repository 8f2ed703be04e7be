"""Plugins: named functions or external programs that order, cover or tile a group of points.

A program lies in a folder's subfolder of its kind, as a file or as a folder with an `index` file; it must be
there under the same path where tasks run.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracover.operators.grouping import dealt

REGISTRY: dict[str, dict[str, Callable]] = {"clustering": {}, "routing": {}, "bootstrap": {}}
INTERPRETERS = {"py": "python3", "js": "node", "sh": "bash", "ts": "tsx"}
_PAIR = re.compile(r"(-?[0-9]+(?:\.[0-9]+)?)\s*,\s*(-?[0-9]+(?:\.[0-9]+)?)")


def register(kind: str, name: str, run: Callable[[pd.DataFrame, dict], pd.DataFrame]) -> None:
    REGISTRY[kind][name] = run


def programs(folder: str, kind: str) -> dict[str, str]:
    """The programs of a kind below a folder: name (a file's with its suffix) -> path of what is run."""
    out, own = {}, Path(folder, kind)
    for p in sorted(own.iterdir()) if own.is_dir() else ():
        index = sorted(p.glob("index.*")) if p.is_dir() else []
        if not p.name.startswith(".") and (p.is_file() or index):
            out[p.name] = str(index[0] if index else p)
    return out


def listed(folder: str | None = None) -> dict[str, list[str]]:
    """The names of each kind: registered functions, and programs below a folder."""
    return {k: sorted({*v, *(programs(folder, k) if folder else ())}) for k, v in REGISTRY.items()}


def encode(g: pd.DataFrame) -> str:
    """`lat,lon lat,lon`: what a program gets."""
    return " ".join(f"{a!r},{b!r}" for a, b in zip(g["lat"].tolist(), g["lon"].tolist(), strict=True))


def decode(text: str) -> pd.DataFrame:
    """Points of a program's output; a last point equal to the first goes. No point is an error."""
    points = [(float(a), float(b)) for a, b in _PAIR.findall(text)]
    if not points:
        raise ValueError(f"no point in the plugin's output: {text[:200]!r}")
    if len(points) > 1 and points[-1] == points[0]:
        points.pop()
    return pd.DataFrame(points, columns=["lat", "lon"])


def command(path: str, args: str = "", **options) -> list[str]:
    """The command line: interpreter by suffix, unless leading arguments name another; options as --name value."""
    words = args.split()
    own = []
    while words and not words[0].startswith("--"):
        own.append(words.pop(0))
    suffix = path.rpartition(".")[2]
    head = [*own, path] if own else [INTERPRETERS[suffix], path] if suffix in INTERPRETERS else [path]
    return [*head, *words, *(x for k, v in options.items() for x in (f"--{k}", str(v)))]


def run(points: DataFrame, kind: str, name: str, key: str, split: Column | None = None, joiner: Callable[[DataFrame], DataFrame] | None = None, folder: str | None = None, **options) -> DataFrame:
    """(key, seq, lat, lon): a plugin over every group; a failed group fails the job.

    name is a registered function, a program below folder or a program's path. With split, each cell of a
    group is run on its own; joiner makes one sequence of the cells' (key, cell, seq, lat, lon), else the
    cells follow each other.
    """
    plugin = REGISTRY[kind].get(name)
    path = programs(folder, kind).get(name, name) if folder else name

    def one(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.drop(columns="cell")
        if plugin:
            out = plugin(g, options)
        else:
            done = subprocess.run(command(path, **options), input=encode(g), capture_output=True, text=True, check=True)
            out = decode(done.stdout)
        return pd.DataFrame({key: k[0], "cell": k[1], "seq": range(len(out)), "lat": out["lat"].to_numpy(), "lon": out["lon"].to_numpy()})

    rows = points.select(key, (F.lit(0) if split is None else split).cast("long").alias("cell"), "lat", "lon")
    out = dealt(rows, key, "cell").groupBy(key, "cell").applyInPandas(one, f"{key} long, cell long, seq long, lat double, lon double")
    if split is None:
        return out.drop("cell")
    if joiner:
        return joiner(out)
    return out.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy("cell", "seq")).cast("long") - 1).drop("cell")
