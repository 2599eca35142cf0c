"""The entry module without the training-data folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_training_data(tmp_path, pipeline):
    to = tmp_path / "repo"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "spark-warehouse", *([] if pipeline else ["corpus_pipeline.py"])))
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'self_recovery' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=to, check=True, env={"PATH": "/usr/bin:/bin"})


def test_other_import_errors_surface(monkeypatch):
    import __spark_entry__ as e

    def broken(name):
        raise ModuleNotFoundError("No module named 'nowhere'", name="nowhere")

    monkeypatch.setattr(e.importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        e.queries()
