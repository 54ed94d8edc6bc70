"""The driver's contract holds with and without the llm subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_names_and_sql_belong_together():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the test tables")
def test_flagship(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["k", "kind", "state"] and df.count() > 0


def test_without_llm(tmp_path):
    shutil.copytree(ROOT / "factweave", tmp_path / "factweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_a_missing_library_is_no_missing_subpackage(tmp_path):
    shutil.copytree(ROOT / "factweave", tmp_path / "factweave", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    code = "import sys; sys.modules['pyarrow'] = None; import __spark_entry__"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert (done.returncode != 0) == ((ROOT / "factweave" / "llm").exists() and (ROOT / "corpus_pipeline.py").exists()), done.stderr


def test_nothing_else_imports_llm():
    for p in (ROOT / "factweave").rglob("*.py"):
        if "llm" not in p.parts:
            assert "factweave.llm" not in p.read_text(), p
