"""The driver's contract: entry, queries and SQL."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_alone(tmp_path):
    """Without the optional folders and file, the other queries are still there, and run."""
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    code = f"""
import __spark_entry__ as e
assert e.__file__.startswith({str(tmp_path)!r})
assert len(e.queries()) == 24 == len(e.oracle_sql())
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("marker_scan", "ignored_paths", "directory_sizes"):
    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k in ("PATH", "JAVA_HOME", "HOME")} | {"PYTHONPATH": str(tmp_path / "r"), "PYSPARK_PYTHON": sys.executable}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=env)


def test_mistakes_in_optional_modules_are_raised(tmp_path):
    """A module of the repository that is there but can't be imported isn't taken for an absent one."""
    for line, ends in (("from lodestone.llm import nothing_of_this_name", 1), ("import a_library_that_is_absent", 0)):
        place = tmp_path / str(ends)
        shutil.copytree(ROOT, place, ignore=shutil.ignore_patterns(".git", "__pycache__"))
        if not (place / "lodestone/llm").exists():
            (place / "lodestone/llm").mkdir()
            (place / "lodestone/llm/__init__.py").touch()
        (place / "lodestone/llm/registry.py").write_text(line + "\n")
        run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=place, env=os.environ | {"PYTHONPATH": str(place)}, capture_output=True)
        assert run.returncode == ends, run.stderr
