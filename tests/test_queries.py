"""Every query that has SQL gives what the SQL gives, at any number of partitions."""

import math

import duckdb
import pytest

from pagewright.plans import report_queries, run_queries  # noqa: F401 - each adds its queries
from pagewright.plans.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return float(value) if type(value).__name__ == "Decimal" else value


def rows_of(columns, rows):
    names = sorted(columns)
    return sorted(repr(tuple(plain(dict(zip(columns, r, strict=True))[n]) for n in names)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, oracle, name):
    found = QUERIES[name](spark, FOLDER)
    wanted = oracle.sql(SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(found.columns, map(tuple, found.collect())) == rows_of(list(wanted.columns), wanted.fetchall())


@pytest.mark.parametrize("name", ["visual_components", "reconstruct_text", "ctc_decode", "case_parity", "schedule_sim"])
def test_partitions_do_not_matter(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found = QUERIES[name](spark, FOLDER)
            results.append(rows_of(found.columns, map(tuple, found.collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


@pytest.mark.parametrize("name", ["stream_telemetry", "stream_stale_replies"])
def test_streams_read_tables_of_many_files(spark, tmp_path, name):
    spark.read.parquet(f"{FOLDER}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    one, many = (QUERIES[name](spark, folder) for folder in (FOLDER, str(tmp_path)))
    wanted = rows_of(one.columns, map(tuple, one.collect()))
    assert wanted and rows_of(many.columns, map(tuple, many.collect())) == wanted
