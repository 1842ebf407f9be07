from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def compare(spark):
    """Runs a query and its SQL on one folder of tables and returns both as sorted rows."""
    import duckdb

    def run(query, sql, folder):
        con = duckdb.connect()
        for p in Path(folder).glob("*.parquet"):
            con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        df = query(spark, str(folder))
        columns = sorted(df.columns)
        other = con.sql(sql)
        assert sorted(other.columns) == columns
        text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
        return text(tuple(r) for r in df.select(*columns).collect()), text(other.select(*(f'"{c}"' for c in columns)).fetchall())

    return run
