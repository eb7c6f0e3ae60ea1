"""The driver's entry works with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("gone", [(), ("corpus_pipeline.py", "vellumgrid/llm"), ("vellumgrid/llm",)])
def test_entry_imports(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    for name in gone:
        at = copy / name
        shutil.rmtree(at) if at.is_dir() else at.unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.split()
    have = os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")) and os.path.isdir(os.path.join(ROOT, "vellumgrid", "llm")) and not gone
    assert int(out[-2]) >= 50 and out[-1] == str(have)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
