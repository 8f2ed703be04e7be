"""Registry of the library's queries: a function over fixture views and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terracover.sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Views:
    """Fixture views of one data folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return fixtures.view(self.spark, self.sf_dir, name)


def query(views: str = "", sql: str | None = None):
    """Registers a function of Views under its name, with the SQL over the named views where there is one."""

    def add(f: Callable[[Views], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = fixtures.with_views(views, sql) if views else sql
        return f

    return add


#: SQL pieces that several oracles share.
HAVERSINE = "(2*6371008.8*asin(least(1.0, sqrt(pow(sin(radians({b}lat-{a}lat)/2),2)+cos(radians({a}lat))*cos(radians({b}lat))*pow(sin(radians({b}lon-{a}lon)/2),2)))))"


def haversine(a: str, b: str) -> str:
    return HAVERSINE.format(a=a + ".", b=b + ".")


def inside(points: str, cols: str = "p.id, p.lat, p.lon") -> str:
    """SELECT of the points in any fence with the fence: brute force over all edges."""
    return f"SELECT {cols}, e.fid FROM {points} p JOIN edge e ON ((e.ey1 > p.lat) <> (e.ey2 > p.lat)) AND p.lon < (e.ex2-e.ex1)*(p.lat-e.ey1)/(e.ey2-e.ey1)+e.ex1 GROUP BY {cols}, e.fid HAVING count(*) % 2 = 1"
