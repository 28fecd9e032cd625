"""Every registered query that has SQL gives the rows of that SQL; the others run and have rows."""

import pathlib
import shutil
import subprocess
import sys

import pytest
from conftest import same

from penumbra.plans.registry import oracle_sql, queries

QUERIES, SQL = queries(), oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, duck, name):
    same(QUERIES[name](spark, sf_dir), duck.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("gone", [["penumbra/llm", "tests/llm"], ["penumbra/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_queries_are_listed_without_the_training_data_part(tmp_path, gone):
    root = pathlib.Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for g in gone:
        at = tmp_path / "r" / g
        shutil.rmtree(at) if at.is_dir() else at.unlink(missing_ok=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries(), *e.oracle_sql())"], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    names = set(said.stdout.split())
    assert set(QUERIES) <= names and "pipeline" not in names
    assert any(n.startswith("op1_") for n in names) is ("penumbra/llm" not in gone and (root / "penumbra/llm").exists())
