"""The entry file works without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("quadrat/llm",), ("quadrat/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_imports_without_training_data_operators(tmp_path, gone):
    for name in ("quadrat", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            left_out = [os.path.basename(g) for g in gone if g.startswith(name)]
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", *left_out))
        elif os.path.exists(source) and name not in gone:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op1_') for n in q), set(e.oracle_sql()) <= set(q))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(got[0]) >= 84 and got[1:] == ["False", "True"]
