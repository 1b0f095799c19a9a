"""The driver contract on a copy of the library without its text operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names_in(folder):
    code = "import __spark_entry__ as e; print(*sorted(e.queries()), *sorted(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": folder})
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def test_entry_imports_without_the_text_operators(tmp_path):
    shutil.copytree(f"{ROOT}/roomtable", tmp_path / "roomtable", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path) if os.path.exists(f"{ROOT}/corpus_pipeline.py") else None
    names = names_in(str(tmp_path))
    assert "confusion_totals" in names
    assert not [n for n in names if n == "pipeline" or n.startswith("op1")]
