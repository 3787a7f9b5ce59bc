import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), any(k.startswith('op1') or k == 'pipeline' for k in q), set(o) <= set(q))"


def _ask(root: str) -> list[str]:
    run = subprocess.run([sys.executable, "-c", ASK], cwd=root, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return run.stdout.split()


def _copy(to, *without: str) -> str:
    root = str(to / "copy")
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *without))
    return root


def test_queries_without_the_llm_folders(tmp_path):
    """corpus_pipeline.py may stay or go; the other queries come either way."""
    n, oracles, llm, known = _ask(_copy(tmp_path))
    assert int(n) > 200 and int(oracles) > 200 and (llm, known) == ("False", "True")


def test_queries_without_the_pipeline_too(tmp_path):
    assert _ask(_copy(tmp_path, "corpus_pipeline.py"))[2] == "False"
