"""Every registered query with SQL gives what DuckDB gives."""

import os

import duckdb
import pytest

from planquarry.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, tmp_path, name):
    registry.QUERIES[name](spark, SF).write.parquet(f"file://{tmp_path}/o")
    duck.execute(f"CREATE OR REPLACE TEMP TABLE b AS SELECT * FROM '{tmp_path}/o/*.parquet'")
    if name not in registry.ORACLE_SQL:
        assert duck.execute("SELECT count(*) FROM b").fetchone()[0] > 0
        return
    duck.execute(f"CREATE OR REPLACE TEMP TABLE a AS {registry.ORACLE_SQL[name]}")
    columns = sorted((r[0], r[1]) for r in duck.execute("DESCRIBE a").fetchall())
    assert columns == sorted((r[0], r[1]) for r in duck.execute("DESCRIBE b").fetchall())
    names = ", ".join(f'"{c}"' for c, _ in columns)
    for x, y in (("a", "b"), ("b", "a")):
        assert duck.execute(f"SELECT {names} FROM {x} EXCEPT ALL SELECT {names} FROM {y}").fetchall() == []
