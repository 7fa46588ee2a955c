"""The driver contract: flagship, registrations and check texts."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from proofline.plans.views import TABLES

FOLDER = "/root/testdata/sf0.001"


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 150


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns[0] == "priority_label" and rows.count() >= 1


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_check_texts_can_be_planned():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    for text in entry.oracle_sql().values():
        db.execute("EXPLAIN " + text)
