"""The library without the subpackage for training text."""

import pathlib
import re
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent
PARTS = ["reelmill", "tests", "__spark_entry__.py"]


def test_a_copy_without_the_folders(tmp_path):
    """Both folders and the pipeline are gone; the entry and the other tests' modules are imported, and a query runs."""
    skip = shutil.ignore_patterns("__pycache__", "llm")
    for name in PARTS:
        (shutil.copytree(ROOT / name, tmp_path / name, ignore=skip) if (ROOT / name).is_dir() else shutil.copy(ROOT / name, tmp_path / name))
    assert not [p for p in tmp_path.rglob("*") if "llm" in p.parts[len(tmp_path.parts) :]]
    code = (
        "import glob, importlib, os; import __spark_entry__ as e; q = e.queries(); assert e.__file__.startswith(os.getcwd()), e.__file__; assert len(q) > 50 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q);"
        "[importlib.import_module('tests.' + os.path.basename(f)[:-3]) for f in glob.glob('tests/test_*.py')];"
        "from pyspark.sql import SparkSession; spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.local.dir', os.getcwd()).getOrCreate(); assert q['metric_pivot'](spark, '/root/testdata/sf0.001').count() > 0; spark.stop()"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "PYTHONPATH": str(tmp_path), **{k: v for k, v in __import__("os").environ.items() if k in ("JAVA_HOME", "SPARK_HOME", "PATH")}})


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "reelmill").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", path.read_text()), path
