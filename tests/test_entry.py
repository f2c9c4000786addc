"""The entry without its optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), any(n.startswith('op') for n in q))"


@pytest.mark.parametrize("gone", [("corpusmill/llm", "tests/llm"), ("corpusmill/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_imports_without_the_optional_parts(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *[os.path.basename(g) for g in gone]))
    assert not any((copy / g).exists() for g in gone)
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != ROOT]
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(paths)}, check=True).stdout.split()
    from corpusmill import catalog

    assert out[-2:] == [str(len(catalog.queries())), "False"]
