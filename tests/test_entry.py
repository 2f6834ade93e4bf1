import os
import re
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parent.parent


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    import shutil

    shutil.copytree(REPO / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    shutil.copytree(REPO / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__", "test_entry.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n[:2] == 'op' and n[2].isdigit() for n in q) and 'pipeline' not in q"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
    found = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert found.returncode == 0, found.stdout[-2000:]


def test_a_missing_library_of_the_corpus_operators_is_told(tmp_path):
    """A folder that is there but can't be imported is an error, not a shorter list of queries."""
    import shutil

    shutil.copytree(REPO / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    (tmp_path / "tessera/llm/queries.py").write_text("import no_such_library\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=env, capture_output=True).returncode != 0


def test_nothing_outside_imports_the_corpus_operators():
    for p in (REPO / "tessera").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", p.read_text())
