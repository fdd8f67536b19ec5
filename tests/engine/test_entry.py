import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]


def names(folder):
    code = "import __spark_entry__ as e; print('NAMES', *sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env={"PYTHONPATH": str(folder), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    return set(done.stdout.split("NAMES", 1)[1].split())


def test_entry_works_without_the_training_data_folders(tmp_path):
    shutil.copytree(REPO / "quarry", tmp_path / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    few = names(tmp_path)
    assert "string_pool" in few and not any(n.startswith("op") or n == "pipeline" for n in few)


def test_nothing_else_imports_them():
    for p in (REPO / "quarry").rglob("*.py"):
        if "llm" not in p.parts:
            assert "quarry.llm" not in p.read_text()


def test_an_error_inside_them_is_not_swallowed(tmp_path):
    shutil.copytree(REPO / "quarry", tmp_path / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("raise ValueError('nowhere_at_all')\n")
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode and "nowhere_at_all" in done.stderr


def test_without_a_package_that_only_they_need(tmp_path):
    shutil.copytree(REPO / "quarry", tmp_path / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import nowhere_at_all\n")
    assert "string_pool" in names(tmp_path)
