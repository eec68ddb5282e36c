"""Every query of the engine's own against its SQL, and with rows to compare."""

import math
from collections import Counter

import duckdb
import pytest

from pagemill.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "benchmark embeddings customer part region nation supplier events documents pages conversations lineitem orders labels".split()


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(round(r[i], 9) if isinstance(r[i], float) and not math.isnan(r[i]) else r[i] for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    assert got
    if name in ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = con.execute(ORACLES[name])
        assert got == rows([c[0] for c in want.description], want.fetchall())
