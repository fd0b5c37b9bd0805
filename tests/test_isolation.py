import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_the_rest_stands_without_the_text_operators(tmp_path):
    """Without llm, its tests and the pipeline the queries are still there."""
    gone = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=gone)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), [k for k in e.queries() if k.startswith('op')])"], cwd=tmp_path / "repo", capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    queries, sql, text = said.stdout.split(" ", 2)
    assert int(queries) > 300 and int(sql) > 250 and text.strip() == "[]"


def test_nothing_else_imports_them():
    for f in (ROOT / "tablewright").rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text(), f
