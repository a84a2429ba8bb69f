"""The driver's entry file works without the optional corpus folder."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_corpus_folder(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    shutil.copytree(os.path.join(ROOT, "tidewell"), tmp_path / "tidewell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    run = [sys.executable, "-B", "-c", "import __spark_entry__ as e; print(*sorted(e.queries()), *e.oracle_sql())"]
    out = subprocess.run(run, cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert "feature_row" in out and "pipeline" not in out and not any(n.startswith("op1") for n in out)
