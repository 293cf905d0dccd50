"""The entry with and without its optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q), set(o) <= set(q))"


def copied(tmp_path):
    shutil.copytree(f"{ROOT}/touchline", tmp_path / "touchline", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    if os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)


def run(tmp_path):
    return subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=False)


@pytest.mark.parametrize("left", [False, True])
def test_without_the_text_subpackage(tmp_path, left):
    copied(tmp_path)
    shutil.rmtree(tmp_path / "touchline" / "llm", ignore_errors=True)
    if left:
        (tmp_path / "touchline" / "llm" / "__pycache__").mkdir(parents=True)  # as a deletion of the sources alone leaves it
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    n, extra, named = run(tmp_path).stdout.split()
    assert int(n) > 150 and extra == "0" and named == "True"


def test_a_broken_part_is_not_passed_over(tmp_path):
    copied(tmp_path)
    folder = tmp_path / "touchline" / "llm"
    folder.mkdir(exist_ok=True)
    (folder / "__init__.py").write_text("")
    (folder / "queries.py").write_text("import no_such_library\n")
    r = run(tmp_path)
    assert r.returncode and "no_such_library" in r.stderr
