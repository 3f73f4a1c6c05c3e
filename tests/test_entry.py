"""The entry module: the flagship runs, names match their SQL, and it works without the training-data folder."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).resolve().parent


def test_flagship(spark):
    assert {r.language for r in entry.entry(spark).collect()} == {"ar", "en", "mixed"}


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "talkgrain", tmp_path / "talkgrain", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, capture_output=True, text=True)
    names = said.stdout.split()
    assert "grounded_summary" in names and "pipeline" not in names and not any(n.startswith("op1_") for n in names), said.stderr
