"""Every relational query against DuckDB on the same tables, and the plans that matter."""

import os
from collections import Counter

import pytest

import __spark_entry__
from lodework.plans import archive_queries, driver_queries, scene_queries
from lodework.streaming import drops

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(driver_queries.QUERIES))
def test_query(spark, duck, name):
    df = driver_queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    ran = duck.execute(driver_queries.ORACLE[name])
    at = [d[0] for d in ran.description]
    assert sorted(at) == names
    assert got == Counter(tuple(plain(r[at.index(c)]) for c in names) for r in ran.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(driver_queries.find_chunk(spark, SF))
    assert "EqualTo(l_returnflag,R)" in text and "l_extendedprice" not in text
    assert "TakeOrderedAndProject" in text
    assert "CartesianProduct" not in text


def test_streaming_catalogue(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a").write_bytes(b"PF\4\0\0\0\x0c\0MODL" + b"GEOM\x08\0\0\0\1\0\x10\0\0\0\0\0")
    assert drops.catalogue(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp")) == 1
    (folder / "b").write_bytes(b"strs")
    assert drops.catalogue(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp")) == 2
    got = {(r.type, r.container) for r in spark.read.parquet(f"{tmp_path}/out/entries").collect()}
    assert got == {("packfile", "MODL"), ("strs", "")}
    blobs = spark.read.format("binaryFile").load(str(folder)).selectExpr("path", "content AS data")
    assert [(r.seq, r.fourcc, r.version) for r in drops.chunk_rows(blobs).collect()] == [(0, "GEOM", 1)]


ARCHIVE = {**archive_queries.QUERIES, **scene_queries.QUERIES}


@pytest.mark.parametrize("name", sorted(ARCHIVE))
def test_archive_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = ARCHIVE[name](spark, "")
    got = Counter(tuple(r) for r in df.collect())
    ran = duckdb.connect().execute({**archive_queries.ORACLE, **scene_queries.ORACLE}[name])
    at = [d[0] for d in ran.description]
    assert at == df.columns
    assert got == Counter(ran.fetchall())
