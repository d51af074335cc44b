"""The library without its optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_optional_subpackage(tmp_path):
    shutil.copytree(ROOT / "loomwork", tmp_path / "loomwork", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = set(e.queries()); assert set(e.oracle_sql()) <= n; assert 'text_top5' in n and 'pipeline' not in n; print(len(n))"
    told = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert told.returncode == 0, told.stderr
    assert int(told.stdout) >= 17


def test_nothing_else_imports_the_optional_subpackage():
    for path in (ROOT / "loomwork").rglob("*.py"):
        if "llm" not in path.parts:
            assert "loomwork.llm" not in path.read_text(), path
