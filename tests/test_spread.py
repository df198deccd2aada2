"""Rows dealt out where a table's files would give most of them to few tasks."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pagewright.llm._session import documents
from pagewright.plans import queries


@pytest.fixture
def small_tasks(spark):
    """Files are cut into tasks of 1 KB."""
    wanted = {"spark.sql.files.maxPartitionBytes": "1024", "spark.sql.files.openCostInBytes": "1"}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    yield spark
    for key in wanted:
        spark.conf.unset(key)


def written(folder, name, rows, row_group):
    columns = {"conv_id": range(rows), "turn": [0] * rows, "text": [f"letter {i} here\nother {i * 7919 % rows} line" for i in range(rows)], "doc_id": range(rows)}
    pq.write_table(pa.table({k: list(v) for k, v in columns.items()}), folder / f"{name}.parquet", row_group_size=row_group)


def rows_of_tasks(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_one_row_group_cut_into_many_tasks(small_tasks, tmp_path):
    written(tmp_path, "conversations", 2000, 1 << 20)
    written(tmp_path, "documents", 2000, 1 << 20)
    cores = small_tasks.sparkContext.defaultParallelism
    read = queries.table(small_tasks, str(tmp_path), "conversations")
    assert read.rdd.getNumPartitions() >= cores and rows_of_tasks(read) == [2000]
    for dealt in (queries.spread(read), documents(small_tasks, str(tmp_path)), queries.QUERIES["score_cases"](small_tasks, str(tmp_path))):
        found = rows_of_tasks(dealt)
        assert sum(found) == 2000 and max(found) <= 2 * 2000 // cores
    dealt = queries.spread(read)
    assert sorted(dealt.collect()) == sorted(read.collect())


def test_even_tasks_stay(small_tasks, tmp_path):
    written(tmp_path, "conversations", 2000, 100)
    read = queries.table(small_tasks, str(tmp_path), "conversations")
    assert queries.spread(read) is read


def test_few_rows_and_none(small_tasks, tmp_path):
    for rows in (0, 1, 3):
        folder = tmp_path / str(rows)
        folder.mkdir()
        written(folder, "conversations", rows, 1 << 20)
        assert queries.spread(queries.table(small_tasks, str(folder), "conversations")).count() == rows


def test_rows_of_a_task_are_bounded(small_tasks, tmp_path, monkeypatch):
    from pagewright import shared

    monkeypatch.setattr(shared, "ROWS_A_TASK", 100)
    written(tmp_path, "conversations", 2000, 1 << 20)
    assert queries.spread(queries.table(small_tasks, str(tmp_path), "conversations")).rdd.getNumPartitions() == 20


def test_last_tasks_leave_no_cores_idle(small_tasks, tmp_path):
    cores = small_tasks.sparkContext.defaultParallelism
    folder = tmp_path / "conversations.parquet"
    folder.mkdir()
    small_tasks.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    small_tasks.conf.set("spark.sql.files.openCostInBytes", str(1 << 20))  # a task for each file
    for i in range(cores + 1):
        written(folder, f"part-{i}", 100, 1 << 20)
    read = queries.table(small_tasks, str(tmp_path), "conversations")
    assert rows_of_tasks(read) == [100] * (cores + 1)
    assert queries.spread(read) is read
    assert len(rows_of_tasks(queries.spread(read, even=True))) == cores
    found = queries.QUERIES["score_cases"](small_tasks, str(tmp_path))
    assert len(rows_of_tasks(found)) == cores and found.count() == 100 * (cores + 1)
