"""The driver entry, with and without the corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]

PART = ["__spark_entry__.py", "corpus_pipeline.py", "tessera"]


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_entry_without_the_corpus_subpackage(tmp_path, also):
    for name in PART:
        at = ROOT / name
        if at.is_dir():
            shutil.copytree(at, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", "llm"))
        elif at.exists() and name not in also:
            shutil.copy(at, tmp_path / name)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(sorted(set(e.oracle_sql()) - set(q)), 'pipeline' in q, any(n.startswith('op1') for n in q), len(q) > 40)"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.stdout.split("\n")[0] == "[] False False True", said.stderr
