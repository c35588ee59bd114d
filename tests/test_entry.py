"""The entry module with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries(), any(n.startswith('op1') for n in e.queries()))"


def counted(folder):
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_entry_without_the_subpackage(tmp_path):
    """Whatever of the optional parts is taken out, the other queries stay."""
    from slipwatch.plans.catalog import ORACLE, QUERIES

    skip = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(os.path.join(ROOT, "slipwatch"), tmp_path / "slipwatch", ignore=skip)
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    assert counted(tmp_path) == [str(len(QUERIES)), str(len(ORACLE)), "False", "False"]
    with open(tmp_path / "corpus_pipeline.py", "w") as f:
        f.write("from slipwatch.llm import count_tree\n")
    assert counted(tmp_path) == [str(len(QUERIES)), str(len(ORACLE)), "False", "False"]
