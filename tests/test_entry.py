"""The entry module with and without the text operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_registry(spark):
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert registry.entry(spark).limit(1).count() == 1


def test_without_text_operators(tmp_path):
    shutil.copytree(f"{ROOT}/cadenza", tmp_path / "cadenza", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') for n in q); assert 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
