"""Every corpus query with SQL gives what DuckDB gives."""

import os

import duckdb
import pytest

from planquarry.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, tmp_path, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    registry.QUERIES[name](spark, SF).write.parquet(f"file://{tmp_path}/o")
    duck.execute(f"CREATE TEMP TABLE b AS SELECT * FROM '{tmp_path}/o/*.parquet'")
    duck.execute(f"CREATE TEMP TABLE a AS {registry.ORACLE_SQL[name]}")
    names = ", ".join(f'"{r[0]}"' for r in sorted(duck.execute("DESCRIBE a").fetchall()))
    assert duck.execute("SELECT count(*) FROM a").fetchone()[0] > 0
    for x, y in (("a", "b"), ("b", "a")):
        assert duck.execute(f"SELECT {names} FROM {x} EXCEPT ALL SELECT {names} FROM {y}").fetchall() == []
