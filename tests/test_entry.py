"""The entry module, with and without the optional subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_works_without_the_optional_parts(tmp_path):
    shutil.copytree(f"{HERE}/huegrid", tmp_path / "huegrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{HERE}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op1') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_a_broken_dependency_of_the_optional_parts_is_an_error(tmp_path):
    shutil.copytree(f"{HERE}/huegrid", tmp_path / "huegrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{HERE}/__spark_entry__.py", tmp_path)
    (tmp_path / "huegrid" / "llm").mkdir()
    for name, text in (("__init__", ""), ("queries", "import no_such_module_at_all\n")):
        (tmp_path / "huegrid" / "llm" / f"{name}.py").write_text(text)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0 and "no_such_module_at_all" in done.stderr
