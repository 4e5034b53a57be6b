"""The driver's contract, with and without the training-data subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as engine

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    df = engine.entry(spark)
    assert df.columns[0] == "ROW_ID" and df.count() > 0


def test_names():
    assert set(engine.oracle_sql()) <= set(engine.queries())


def test_rest_works_alone(tmp_path):
    for name in ("notewright", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'recall_rows' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(q) == set(e.oracle_sql()) | {'tokenize_documents'}"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "notewright").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "notewright.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
