"""The entry point with the optional package, and without it."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as E

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [(), ("corpus_pipeline.py",), ("corpus_pipeline.py", "llm"), ("llm",)])
def test_queries_without_optional_parts(tmp_path, gone):
    for f in ROOT.glob("*.py"):
        if f.name not in gone:
            shutil.copy(f, tmp_path)
    shutil.copytree(ROOT / "pagewright", tmp_path / "pagewright", ignore=shutil.ignore_patterns("__pycache__", *gone))
    code = "import __spark_entry__ as E; print(len(E.queries()), len(E.oracle_sql()), 'pipeline' in E.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert out.returncode == 0, out.stderr
    count, twins, pipeline = out.stdout.split()
    assert int(count) > 90 and int(twins) > 90
    there = not gone and (ROOT / "corpus_pipeline.py").exists() and (ROOT / "pagewright" / "llm").exists()
    assert pipeline == str(there)


def test_other_import_errors_are_raised(monkeypatch):
    def fail(name):
        raise ModuleNotFoundError("x", name="numpy_like")

    monkeypatch.setattr(E.importlib, "import_module", fail)
    with pytest.raises(ModuleNotFoundError):
        E._optional("pagewright.llm.queries")
