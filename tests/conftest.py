import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lectern.session import session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session(
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "3",
            "spark.sql.codegen.wholeStage": "false",  # compiling takes most of the time on small tables
            "spark.sql.codegen.factoryMode": "NO_CODEGEN",
            "spark.sql.adaptive.enabled": "false",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


def same_as_sql(spark, folder, query, sql):
    """Runs a query as it is shipped, with AQE and generated code, and its SQL; the rows must be the same."""
    import duckdb

    shipped = {"spark.sql.adaptive.enabled": "true", "spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"}
    before = {k: spark.conf.get(k) for k in shipped}
    try:
        for k, v in shipped.items():
            spark.conf.set(k, v)
        df = query(spark, folder)
        got = [tuple(r) for r in df.collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    with duckdb.connect() as con:
        for name in os.listdir(folder):
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{name}')")
        result = con.execute(sql)
        columns = [c[0] for c in result.description]
        want = result.fetchall()
    assert sorted(df.columns) == sorted(columns)
    ordered = lambda rows, names: sorted(repr(tuple(r[i] for i in sorted(range(len(names)), key=lambda i: names[i]))) for r in rows)
    assert ordered(got, df.columns) == ordered(want, columns)
