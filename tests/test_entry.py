"""The driver's contract, with and without the optional part."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    q, s = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(s) <= set(q) and len(q) > 80


def test_imports_without_the_optional_part(tmp_path):
    shutil.copytree(ROOT / "lumenflow", tmp_path / "lumenflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 70 and 'pipeline' not in e.queries(); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"}, timeout=60)


def test_nothing_else_imports_the_optional_part():
    files = [p for p in [*(ROOT / "lumenflow").rglob("*.py"), *(ROOT / "jobs").rglob("*.py"), ROOT / "tests/test_jobs.py"] if "llm" not in p.relative_to(ROOT).parts]
    assert files and not any(x in p.read_text() for p in files for x in ("lumenflow.llm", "import corpus_pipeline"))
