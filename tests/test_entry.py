"""The entry point with and without the optional package."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]
SHOW = """
import __spark_entry__ as entry
print(*sorted(entry.queries()))
print(*sorted(entry.oracle_sql()))
"""


def names(folder):
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True,
                         env=os.environ | {"PYTHONPATH": "", "PYTHONDONTWRITEBYTECODE": "1"}).stdout
    return [set(line.split()) for line in out.splitlines()]


def test_entry_point_without_optional_package(tmp_path):
    skipped = shutil.ignore_patterns(".git", "__pycache__", "llm")
    for partial in (False, True):
        copy = tmp_path / f"copy-{partial}"
        shutil.copytree(ROOT, copy, ignore=skipped)
        if partial:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        found, oracles = names(copy)
        from suite.oracles import ORACLES
        from suite.queries import QUERIES
        assert found == set(QUERIES) and oracles == set(ORACLES)


def test_entry_point_with_all_parts():
    found, oracles = names(ROOT)
    assert oracles <= found
