"""Every registered query against its SQL twin; the others by their invariants."""

from concurrent.futures import ThreadPoolExecutor

import oracle
import pytest

from terracover.plans import cells, changes, further, held, parts, relational, spatial  # noqa: F401
from terracover.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def _run(spark, name):
    df = QUERIES[name](spark, SF)
    return (df.columns, df.collect()) if name in ORACLES else df.count()


@pytest.fixture(scope="module")
def results(spark, request):
    """The chosen tests' queries as futures, some running at once: most of their time is planning."""
    names = [i.callspec.params["name"] for i in request.session.items if i.path == request.path]
    with ThreadPoolExecutor(6) as pool:
        yield {n: pool.submit(_run, spark, n) for n in names}
        pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(results, con, name):
    assert oracle.compare(*results[name].result(), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(results, name):
    rows = results[name].result()
    assert rows > 0
