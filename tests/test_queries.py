"""Every registered core query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

from chunkwell.plans.queries import ORACLE, QUERIES

D = "/root/testdata/sf0.001"


def shown(rows):
    return sorted(tuple(repr(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, D)
    columns = sorted(df.columns)
    got = shown(map(tuple, df.select(*columns).collect()))
    if name not in ORACLE:
        assert got
        return
    r = duck.execute(ORACLE[name])
    at = {c[0]: i for i, c in enumerate(r.description)}
    assert sorted(at) == columns
    assert got == shown(tuple(x[at[c]] for c in columns) for x in r.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_shared_folder_is_named_by_the_cluster():
    from types import SimpleNamespace

    from chunkwell.sources.session import shared_root

    def session(master, folder=None):
        held = {"spark.checkpoint.dir": folder} if folder else {}
        conf = SimpleNamespace(get=lambda k, d=None: held.get(k, d), set=held.__setitem__)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))

    assert shared_root(session("yarn", "hdfs:///scratch/")) == "hdfs:///scratch"
    assert shared_root(session("local[4]")).startswith("file:/")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_root(session(master))


def test_core_works_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/chunkwell", tmp_path / "chunkwell", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    count = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    run = lambda: subprocess.run([sys.executable, "-c", count], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    (tmp_path / "chunkwell/llm").mkdir(exist_ok=True)
    (tmp_path / "chunkwell/llm/queries.py").write_text("import a_module_that_is_not_there")
    assert run() == [str(len(QUERIES)), str(len(ORACLE))]
    shutil.rmtree(tmp_path / "chunkwell/llm")
    assert run() == [str(len(QUERIES)), str(len(ORACLE))]
