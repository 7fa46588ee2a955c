"""Tasks and parts stay of one size as the tables grow, and a held scan is run once."""

from __future__ import annotations

import os
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from proofline.operators import python_calls, source_rules
from proofline.plans import correlation, evaluation, views
from proofline.sources import collect

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def largest_share(frame):
    """Rows of the fullest partition over all rows."""
    sizes = [r["count"] for r in frame.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) / sum(sizes)


@needs_tables
def test_views_are_dealt_in_proportion_to_their_rows(spark, monkeypatch):
    few = views.Tables(spark, FOLDER)
    assert few.tasks("v_evidence") == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(views, "SPREAD", {name: (table, key, 10) for name, (table, key, _) in views.SPREAD.items()})
    for name, (table, _, _) in views.SPREAD.items():
        rows = few.table(table).count()
        assert few.tasks(name) == max(spark.sparkContext.defaultParallelism, -(-rows // 10))
        assert few.view(name).rdd.getNumPartitions() == few.tasks(name)
        assert few.view(name).count() == rows


@needs_tables
def test_reordered_evidence_is_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(views, "SPREAD", {name: (table, key, 100) for name, (table, key, _) in views.SPREAD.items()})
    tables = views.Tables(spark, FOLDER)
    given = tables.view("v_evidence").drop("location").collect()
    for moved in (correlation.reordered(tables), *evaluation.evidence_runs(tables)[1:]):
        assert largest_share(moved) < 0.1
        assert sorted(map(str, moved.drop("location").collect())) == sorted(map(str, given))


def test_statements_come_in_parts_of_bounded_size(monkeypatch):
    monkeypatch.setattr(source_rules, "PART_BYTES", 2000)
    files = {"a.py": "x = getattr(\no)\ny = 1; z = 2\n" * 40, "empty.go": None, "b.java": "int a;\nint b;", "c.py": "k = 1\n" * 100}
    batch = pa.RecordBatch.from_pydict({"path": list(files), "extension": ["." + p.split(".")[1] for p in files], "content": list(files.values())})
    parts = list(source_rules._split_files(iter([batch])))
    assert len(parts) > 10
    assert all(sum(len(text) + source_rules.ROW_BYTES for text in part.column("text").to_pylist()) < 2000 + 300 for part in parts)
    found = [tuple(row.values()) for part in parts for row in part.to_pylist()]
    wanted = [
        (path, "." + path.split(".")[1], *row.values())
        for path, text in files.items() for row in source_rules.marked_statements(text, "." + path.split(".")[1])
    ]
    assert found == wanted


def test_facts_come_in_parts(spark):
    calls = python_calls.PART_ROWS + 50
    rows = spark.createDataFrame([("a.py", "import hashlib\n" + "hashlib.md5(b)\n" * calls), ("b.py", "def broken(:")], "path string, content string")
    kinds = {r["kind"]: r["count"] for r in python_calls.facts(rows).groupBy("kind").count().collect()}
    assert kinds == {"import": 1, "call": calls, "error": 1}


def test_texts_leave_a_batch_one_at_a_time():
    """Facts of a batch cost the memory of one file's text and one part, not of all texts at once."""
    filler = "# " + "x" * 20_000 + "\n"
    batch = pa.RecordBatch.from_pydict({"path": [f"f{i}.py" for i in range(500)], "content": [f"import hashlib\n{filler}k = {i}\n" for i in range(500)]})
    tracemalloc.start()
    found = sum(part.num_rows for part in python_calls._facts_of(iter([batch])))
    highest = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 500
    assert highest < 2_000_000 < batch.nbytes


def test_a_task_is_dealt_few_files():
    """An Arrow batch has up to 10,000 rows: fewer files to a task keep its batch, and so its Python worker, of one size from 0.1 GB on."""
    assert views.SPREAD["v_code"][2] <= 5_000


def test_blank_statements_are_no_candidates(spark):
    rows = spark.createDataFrame([("      ",), ("",), ("x = rsa.generate()",)], "text string")
    assert [r["text"] for r in source_rules.candidates(rows, "text").collect()] == ["x = rsa.generate()"]


def test_held_scan_runs_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(len(batch))
            yield batch

    rows = spark.range(10).mapInPandas(counted, "id long")
    held = collect.Scan(rows, rows, rows).held()
    assert runs.value == 20
    assert [held.evidence.count(), held.evidence.count(), held.failures.count()] == [10, 10, 10]
    assert runs.value == 20
