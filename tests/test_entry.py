"""The entry file works with and without the training-data folder."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_imports_without_the_optional_parts():
    code = "import sys; sys.modules['tonearchive.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_optional_folder():
    for path in (ROOT / "tonearchive").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()
