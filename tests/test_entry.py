import shutil
import subprocess
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [("tablewright/llm", "tests/llm"), ("tablewright/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_the_text_operators(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(TOP, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "spark-warehouse"))
    for name in gone:
        shutil.rmtree(copy / name, ignore_errors=True)
        (copy / name).unlink(missing_ok=True) if (copy / name).is_file() else None
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'dq_issue_log' in q, 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    n, core, pipeline, known = out.stdout.split()[-4:]
    assert int(n) >= 70 and (core, pipeline, known) == ("True", "False", "True")
