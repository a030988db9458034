"""The driver contract, with and without the training-data part."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60


@pytest.mark.parametrize("pipeline", [False, True])
def test_works_without_the_training_part(tmp_path, pipeline):
    """With both llm folders gone, and the pipeline too or left behind, the rest imports and its
    tests pass."""
    keep = shutil.ignore_patterns("llm", "__pycache__", ".git", "*.json", "*.txt", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "repo", ignore=keep)
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert 'rule_labels' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env).returncode == 0
    names = [sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests/unit/test_entry.py", "-k", "names"]
    assert subprocess.run(names, cwd=tmp_path / "repo", env=env).returncode == 0
