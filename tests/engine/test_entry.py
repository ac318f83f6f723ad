import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[2]


def names(folder):
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print('NAMES', *e.queries())"], cwd=folder, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr[-500:]
    return said.stdout.split("NAMES")[1].split()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [["llm", "corpus_pipeline.py"], ["llm"]])
def test_without_the_training_data_operators(tmp_path, gone):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *gone))
    left = names(tmp_path / "r")
    assert "q_changes_daily" in left and not any(n.startswith("op") or n == "pipeline" for n in left)
