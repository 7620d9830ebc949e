"""Registered queries of this subpackage against their SQL twins."""

import duckdb
import pytest

from bookpulse.llm.queries import ORACLES, QUERIES
from checks.compare import TABLES, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_twin(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[key](spark, FOLDER)
    cursor = con.execute(ORACLES[key])
    assert difference((df.columns, [tuple(r) for r in df.collect()]), ([d[0] for d in cursor.description], cursor.fetchall())) is None


def test_registered():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert {int(k[2:].split("_")[0]) for k in QUERIES if k != "pipeline"} == set(range(1, 14))
