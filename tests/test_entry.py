"""The entry point without the subpackage for training text."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
NAMES = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


@pytest.mark.parametrize("gone", [["kairoscope/llm"], ["kairoscope/llm", "corpus_pipeline.py"]])
def test_entry_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__"))
    for name in gone:
        if (copy / name).is_dir():
            shutil.rmtree(copy / name)
        else:
            (copy / name).unlink(missing_ok=True)
    run = subprocess.run([sys.executable, "-c", NAMES], cwd=copy, env={"PATH": ""}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    for line in run.stdout.splitlines():
        assert "file_history" in line and "op1_" not in line and "pipeline" not in line
