"""The checkout without the corpus operators: it imports, registers its queries, and passes its tests."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert "topic_records" in q and not [n for n in q if n.startswith("op") or n == "pipeline"], sorted(q)
assert o and set(o) <= set(q)
"""


def test_rest_stands_without_the_corpus_operators(tmp_path):
    at = tmp_path / "copy"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for pipeline in (True, False):  # with and without the file that imports them
        if not pipeline:
            (at / "corpus_pipeline.py").unlink(missing_ok=True)
        subprocess.run([sys.executable, "-c", CODE], cwd=at, env=env, check=True, timeout=120)
        subprocess.run([sys.executable, "-m", "pytest", "-q", "--collect-only", "tests"], cwd=at, env=env, check=True, timeout=120, stdout=subprocess.DEVNULL)
