"""The entry module with and without the corpus operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q))"


def names(folder) -> tuple[int, int]:
    out = subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True).stdout.split()
    return int(out[0]), int(out[1])


def test_entry_without_the_corpus_operators(tmp_path):
    bare = tmp_path / "bare"
    shutil.copytree(REPO, bare, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse"))
    whole, ops = names(REPO)
    assert names(bare)[1] == 0
    if (REPO / "tagloom" / "llm").exists():
        assert ops == 11 and names(bare)[0] == whole - 11


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["file_id", "key", "status", "l", "r"]
