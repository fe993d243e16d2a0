"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import numpy as np
import pytest

from ouvidor.plans.all import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for r in frame.astype(object).itertuples(index=False):
        out.append(repr(tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 6) if isinstance(v, float) else getattr(v, "item", lambda v=v: v)() for v in r)))
    return sorted(out)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, small, name):
    got, want = QUERIES[name](spark, small).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_rows_only_queries(spark, small):
    assert {r["ok"] for r in QUERIES["Q_provider_bisect"](spark, small).collect()} == {True, False}
    k = QUERIES["Q_kmeans"](spark, small).toPandas().sort_values("k")
    assert k["k"].tolist() == list(range(2, 11)) and k["escolhido"].sum() == 1
    assert k["inercia"].iloc[-1] < k["inercia"].iloc[0]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_kmeans_runs_all_starts_to_rest(spark):
    from pyspark.sql import functions as F

    from ouvidor.operators import clustering

    sf = "/root/testdata/sf0.01"
    rows = clustering.vectors(spark, sf).orderBy(F.xxhash64("vec_id")).toPandas()
    x, r = np.array(rows["embedding"].tolist(), dtype=float), np.random.default_rng(42)
    want = {}
    for k in range(2, 11):
        for _ in range(10):
            centres, old = clustering.starts(x, k, r), None
            for _ in range(300):
                to = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
                if old is not None and (to == old).all():
                    break
                centres, old = np.array([x[to == i].mean(axis=0) if (to == i).any() else centres[i] for i in range(k)]), to
            want[k] = min(want.get(k, np.inf), ((x - centres[to]) ** 2).sum())
    got = {row["k"]: row["inercia"] for row in QUERIES["Q_kmeans"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] / want[k] - 1) < 1e-6 for k in want)
