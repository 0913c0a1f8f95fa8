import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    from tabularium.session import session, ship

    made = session(
        "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    )
    made.sparkContext.setLogLevel("ERROR")
    yield ship(made)
    made.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return c


def _cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return str(float(v))
    try:
        return f"{float(v):.9g}"
    except (TypeError, ValueError):
        return str(v).removesuffix(" 00:00:00")


@pytest.fixture(scope="session")
def same_rows():
    def check(df, duck, sql):
        columns = sorted(df.columns)
        mine = sorted(str([_cell(r[c]) for c in columns]) for r in df.collect())
        cursor = duck.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        theirs = sorted(str([_cell(row[names.index(c)]) for c in columns]) for row in cursor.fetchall())
        assert mine == theirs

    return check
