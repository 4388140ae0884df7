"""The driver's contract, with and without the corpus subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [("docketry/llm", "tests/llm"), ("docketry/llm", "tests/llm", "corpus_pipeline.py")])
def test_without_the_corpus_operators(tmp_path, gone):
    """A copy of the repository with the folders really deleted: it imports, has its other queries and runs one."""
    root = Path(__spark_entry__.__file__).parent
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        shutil.rmtree(copy / name) if (copy / name).is_dir() else (copy / name).unlink(missing_ok=True)
    code = "import __spark_entry__ as e\nq = e.queries()\nassert len(q) > 150 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q\nassert not e.oracle_sql().keys() - q.keys()"
    path = os.pathsep.join(filter(None, [str(copy), os.environ.get("PYTHONPATH")]))  # the caller's packages stay
    run = lambda *args: subprocess.run([sys.executable, *args], cwd=copy, env=os.environ | {"PYTHONPATH": path}, capture_output=True, text=True)
    assert (done := run("-c", code)).returncode == 0, done.stderr[-2000:]
    assert (found := run("-m", "pytest", "-q", "--collect-only", "tests")).returncode == 0, found.stdout[-2000:]
    # and what is left passes (a part of it here; all of it is what the driver runs)
    if len(gone) == 3:
        assert (done := run("-m", "pytest", "-q", "-x", "tests/test_operators.py", "tests/test_entry.py::test_entry")).returncode == 0, done.stdout[-2000:]
