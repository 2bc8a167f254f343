from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "codeloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(?:from|import)\b.*\bllm\b", path.read_text(), re.M), path


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_the_rest_works_without_them(tmp_path, left):
    """With the subpackage deleted, whether the pipeline is deleted too or was forgotten."""
    import shutil

    for name in left if (ROOT / "corpus_pipeline.py").exists() else ():
        shutil.copy(ROOT / name, tmp_path)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "codeloom", tmp_path / "codeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in q))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert out.returncode == 0, out.stderr
    n, _, any_op = out.stdout.split()
    assert int(n) > 40 and any_op == "False"
