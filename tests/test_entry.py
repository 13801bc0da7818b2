"""The entry without its optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LISTED = "import __spark_entry__ as e; print(*sorted(e.queries()), len(e.oracle_sql()))"


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_entry_imports_without_corpus_operators(tmp_path, pipeline_too):
    left_out = {"llm", "tests", ".git", "__pycache__"} | ({"corpus_pipeline.py"} if pipeline_too else set())
    shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda _, names: left_out.intersection(names))
    run = subprocess.run([sys.executable, "-c", LISTED], cwd=tmp_path / "copy", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    names = run.stdout.split()
    assert run.returncode == 0, run.stderr
    assert "sector_lags" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
