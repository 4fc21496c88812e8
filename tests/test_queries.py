"""The catalogue against its SQL on the sample tables."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from lamella.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)


@pytest.mark.parametrize("name", catalogue.queries())
def test_query_matches_sql(spark, db, name):
    got = catalogue.queries()[name](spark, SF)
    want = db.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [list(want.columns).index(c) for c in got.columns]
    assert sorted([plain(v) for v in r] for r in got.collect()) == sorted([plain(r[i]) for i in order] for r in want.fetchall())


def test_row_group_batches_match_sql_on_several_row_groups(spark, tmp_path):
    pq.write_table(pq.read_table(f"{SF}/events.parquet"), tmp_path / "events.parquet", row_group_size=300)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = catalogue.queries()["row_group_batches"](spark, str(tmp_path)).select("row_group", "batch", "rows").collect()
    assert len(got) > 1 and sorted(map(tuple, got)) == sorted(con.sql(catalogue.oracle_sql()["row_group_batches"]).fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [["lamella/llm"], ["lamella/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_optional_parts(tmp_path, gone):
    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", "*.json"))
    for name in gone:
        path = tmp_path / "copy" / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), set(s) <= set(q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= len(catalogue.queries()) and out[1:] == ["True", "False"]
