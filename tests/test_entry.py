"""The entry with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(len([q for q in e.queries() if q.startswith('op') and q[2].isdigit()]), 'pipeline' in e.queries(), len(e.queries()) > 100)"


def _run(folder):
    env = {**os.environ, "PYTHONPATH": "", "PYTHONDONTWRITEBYTECODE": "1"}
    return subprocess.run([sys.executable, "-c", SHOW], cwd=folder, env=env, capture_output=True, text=True)


def _copy(tmp_path, *left_out):
    skip = shutil.ignore_patterns("__pycache__", ".git", "*.json", "*.md", "*.txt")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda d, names: {*skip(d, names), *(n for n in names if os.path.relpath(os.path.join(d, n), ROOT) in left_out)})
    return tmp_path / "copy"


def test_entry_imports_without_the_corpus_operators(tmp_path):
    for left_out in (("tidemark/llm", "tests/llm", "corpus_pipeline.py"), ("tidemark/llm", "tests/llm")):
        folder = _copy(tmp_path / str(len(left_out)), *left_out)
        done = _run(folder)
        assert done.stdout.split() == ["0", "False", "True"], done.stderr


def test_other_missing_modules_are_errors(tmp_path):
    folder = _copy(tmp_path, "tidemark/functions/numeric.py")
    done = _run(folder)
    assert done.returncode != 0 and "ImportError" in done.stderr
