"""The driver's contract with and without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
PROGRAM = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), sorted(n for n in q if n.startswith('op') or n == 'pipeline'))"


@pytest.mark.parametrize("gone", [["veldra/llm"], ["veldra/llm", "corpus_pipeline.py"]])
def test_the_rest_works_without_the_corpus_operators(tmp_path, gone):
    for name in ("veldra", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    for name in gone:
        path = tmp_path / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-B", "-c", PROGRAM], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    queries, oracles, corpus = said.stdout.split(maxsplit=2)
    assert int(queries) > 80 and int(oracles) > 80 and corpus.strip() == "[]"
