"""The driver contract with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(*sorted(q))"


def names(folder) -> set[str]:
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return set(out.stdout.split())


def copy(to):
    return shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json"))


@pytest.mark.parametrize("left", ["nothing", "pipeline", "empty folder"])
def test_queries_without_the_training_data_operators(tmp_path, left):
    from tessera.plans import queries

    folder = copy(tmp_path / "repo")
    shutil.rmtree(folder / "tessera" / "llm", ignore_errors=True)
    shutil.rmtree(folder / "tests" / "llm", ignore_errors=True)
    if left != "pipeline":
        (folder / "corpus_pipeline.py").unlink(missing_ok=True)
    if left == "empty folder":
        (folder / "tessera" / "llm" / "__pycache__").mkdir(parents=True)
    assert names(folder) == set(queries.QUERIES)
