import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture
def both(spark, tmp_path):
    """Writes tables as Parquet, runs a registered query and its SQL over them and returns both results, rows sorted."""
    from compare import canonical

    from heatloom.llm.queries import ORACLES, QUERIES

    def run(name, **tables):
        con = duckdb.connect()
        for table, frame in tables.items():
            path = f"{tmp_path}/{table}.parquet"
            frame.write.mode("overwrite").parquet(path)
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
        frame = QUERIES[name](spark, str(tmp_path))
        got = canonical(frame.columns, frame.collect())
        cursor = con.execute(ORACLES[name])
        return got, canonical([d[0] for d in cursor.description], cursor.fetchall())

    return run
