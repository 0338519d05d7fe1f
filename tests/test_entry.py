"""The entry points without the optional document part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), set(s) <= set(q), any(n.startswith('op') or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_works_without_the_document_operators(tmp_path, pipeline):
    for part in ("functions", "operators", "plans", "sources", "streaming"):
        shutil.copytree(REPO / "priorwise" / part, tmp_path / "priorwise" / part, ignore=shutil.ignore_patterns("__pycache__"))
    for file in ("priorwise/__init__.py", "priorwise/session.py", "__spark_entry__.py", *["corpus_pipeline.py"] * pipeline):
        if (REPO / file).exists():
            shutil.copy(REPO / file, tmp_path / file)
    out = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    count, contained, documents = out.stdout.split() if not out.returncode else pytest.fail(out.stderr[-500:])
    assert int(count) > 100 and contained == "True" and documents == "False"
