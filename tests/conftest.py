import datetime
import os
from pathlib import Path

import duckdb
import pytest

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from pixelloom.session import build_session

    s = build_session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    folder = DATA / "sf0.001"
    if not folder.exists():
        pytest.skip("no test tables here")
    return str(folder)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    """A value in the form in which both engines' results compare."""
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    if isinstance(v, bytes | bytearray):
        return bytes(v).hex()
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return v


@pytest.fixture(scope="session")
def same(spark, sf, duck):
    """Compares a query with its oracle, rows in any order."""

    def compare(query, sql):
        df = query(spark, sf)
        names = sorted(df.columns)
        mine = sorted(str([plain(r[c]) for c in names]) for r in df.collect())
        other = duck.sql(sql)
        assert sorted(other.columns) == names
        at = [other.columns.index(c) for c in names]
        assert mine == sorted(str([plain(r[i]) for i in at]) for r in other.fetchall())

    return compare
