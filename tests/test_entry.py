"""The driver's contract with and without the text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'fft_power' in q; print(sum(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q))"


@pytest.mark.parametrize("left", ["nothing", "an empty folder", "old bytecode", "the pipeline"])
def test_without_the_text_operators(tmp_path, left):
    shutil.copytree(ROOT / "lattica", tmp_path / "lattica", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if left == "the pipeline":  # whose own imports then fail
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    elif left != "nothing":
        (tmp_path / "lattica/llm" / ("__pycache__" if left == "old bytecode" else "")).mkdir(parents=True)
        if left == "old bytecode":
            (tmp_path / "lattica/llm/__pycache__/queries.cpython-313.pyc").write_bytes(b"old")
    run = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert run.returncode == 0 and run.stdout.split() == ["0"], run.stderr
