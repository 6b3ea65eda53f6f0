import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

REPO = Path(entry.__file__).parent


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert sum(r.n for r in rows) == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("llm",)])
def test_without_the_llm_package(tmp_path, gone):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", *gone, "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'catalog_decisions' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q and e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", check=True, timeout=120)


def test_nothing_else_imports_llm():
    for p in (REPO / "catalith").rglob("*.py"):
        if "llm" not in p.relative_to(REPO).parts:
            assert "catalith.llm" not in p.read_text()
