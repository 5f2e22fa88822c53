"""The library without the training-data subpackage: all other queries stay."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), sorted(k for k in q if k.startswith('op') or k == 'pipeline'), set(e.oracle_sql()) <= set(q))"


@pytest.mark.parametrize("gone", [("tabforge/llm", "tests/llm"), ("tabforge/llm", "tests/llm", "corpus_pipeline.py")])
def test_queries_without_the_subpackage(tmp_path, gone):
    from tabforge.queries import catalog

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__", ".pytest_cache")
                                                         or os.path.relpath(os.path.join(d, n), ROOT) in gone])
    assert not any((copy / g).exists() for g in gone)
    run = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, capture_output=True, text=True, timeout=120,
                         env={**os.environ, "PYTHONPATH": ""})
    assert run.returncode == 0, run.stderr
    assert run.stdout.strip() == f"{len(catalog.QUERIES)} [] True"
    tests = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=copy, capture_output=True, text=True,
                           timeout=300, env={**os.environ, "PYTHONPATH": ""})
    assert tests.returncode == 0, tests.stdout[-2000:]
