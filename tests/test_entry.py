"""The driver's entry points, and that the training-data subpackage can be left out."""

import ast
import importlib
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_registered_queries_have_twins():
    entry = importlib.import_module("__spark_entry__")
    from sluice import queries

    assert set(queries.ORACLES) == set(queries.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "sluice").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] + [getattr(node, "module", None) or ""] if isinstance(node, (ast.Import, ast.ImportFrom)) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_entry_without_the_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "sluice", tmp_path / "sluice", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()), 'pipeline' in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    assert done.stdout.split()[1:] == ["False", "False"], done.stderr
