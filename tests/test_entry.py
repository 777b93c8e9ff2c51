"""The entry points must load with and without the corpus operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len([n for n in q if not n.startswith('op')]), len(e.oracle_sql()))"


def _core_copy(where: Path) -> None:
    """The library without its corpus folder; the pipeline file stays, as a leftover that must not matter."""
    shutil.copytree(ROOT / "emberline", where / "emberline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, where / name)


def test_core_loads_without_the_corpus_operators(tmp_path):
    _core_copy(tmp_path)
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[0]) >= 86


def test_nothing_else_imports_the_corpus_operators():
    for source in (ROOT / "emberline").rglob("*.py"):
        if "llm" not in source.relative_to(ROOT).parts:
            assert "emberline.llm" not in source.read_text(), source
