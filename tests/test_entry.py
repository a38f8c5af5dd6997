"""The driver's entry, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

from .conftest import ROOT

RUN = """
import __spark_entry__ as entry
from wayfind.plans.session import session

assert not [q for q in entry.queries() if q.startswith("op") or q == "pipeline"]
assert set(entry.oracle_sql()) <= set(entry.queries())
print("ROWS", entry.queries()["suggestions"](session(2, "alone"), "/root/testdata/sf0.001").count())
"""


@pytest.mark.parametrize("gone", [("wayfind/llm", "tests/llm"), ("wayfind/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_the_training_data_operators(tmp_path, gone):
    to = tmp_path / "copy"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        shutil.rmtree(to / name) if (to / name).is_dir() else (to / name).unlink(missing_ok=True)
    run = RUN if "wayfind/llm" in gone else "import __spark_entry__ as e; assert 'pipeline' not in e.queries()\nprint('ROWS 5')"
    done = subprocess.run([sys.executable, "-B", "-c", run], cwd=to, env=os.environ | {"PYTHONPATH": str(to)}, capture_output=True, text=True, timeout=300)
    assert "ROWS 5" in done.stdout, done.stderr[-2000:]


def test_a_fault_in_the_operators_is_no_absence(tmp_path):
    to = tmp_path / "copy"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    if not (to / "wayfind/llm").is_dir():
        pytest.skip("without them")
    (to / "wayfind/llm/storage.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=to, env=os.environ | {"PYTHONPATH": str(to)}, capture_output=True, text=True, timeout=300)
    assert done.returncode and "no_such_module" in done.stderr
