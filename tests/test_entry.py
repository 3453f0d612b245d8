"""The library stands without the training-text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_without_the_llm_folders(tmp_path):
    for name in ("sluice", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "sluice" / "llm", ignore_errors=True)
    (tmp_path / "sluice" / "llm" / "__pycache__").mkdir(parents=True)  # as a deleted checkout may leave it
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})


def test_without_what_the_llm_folder_needs(tmp_path):
    (tmp_path / "public_tokenizers.py").write_text("raise ImportError('not here')")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "PYTHONPATH": f"{tmp_path}:{ROOT}"})


def test_nothing_imports_them():
    for path in (ROOT / "sluice").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "sluice.llm" not in path.read_text(encoding="utf-8"), path


def test_all_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
