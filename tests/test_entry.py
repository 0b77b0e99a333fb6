"""The entry points, with and without the optional parts."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

HERE = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "score"] and df.count() > 0


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_optional_parts(tmp_path):
    """The entry points import, and have the other queries, where the subpackage and its pipeline are not there."""
    shutil.copytree(HERE / "lexigrove", tmp_path / "lexigrove", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(HERE / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; from lexigrove.queries import QUERIES; assert e.queries().keys() == QUERIES.keys(); assert 'pipeline' not in e.oracle_sql()"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
