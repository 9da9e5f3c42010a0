"""Every query at the smallest scale: against its SQL where there is some, else that it gives rows with a stable schema."""

import datetime
import os

import pytest

from mlquarry.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}") + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    base = duckdb.connect()
    for f in os.listdir(DATA):
        base.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return base


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    if name in ORACLE_SQL:
        cursor = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(names)
        want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall()), key=repr)
        assert sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr) == want


@pytest.fixture(scope="module")
def no_rows(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("none")
    for f in os.listdir(DATA):
        spark.read.parquet(f"{DATA}/{f}").where("false").write.parquet(f"{folder}/{f}")
    return str(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_empty_tables(spark, no_rows, name):
    if name in ("logistic_regression", "linear_svc", "svc_predict"):
        with pytest.raises(ValueError, match="two classes"):
            QUERIES[name](spark, no_rows)
    else:
        QUERIES[name](spark, no_rows).collect()
