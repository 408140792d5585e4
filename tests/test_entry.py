"""The entry module works without the optional subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

CODE = f"""
import __spark_entry__ as e
from pyspark.sql import SparkSession
names = set(e.queries())
assert set(e.oracle_sql()) <= names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.queries()["depth_filter"](spark, "{SF}").count() > 0
spark.stop()
"""


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_without_the_subpackage(tmp_path, pipeline_stays):
    for name in ("strandloom", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        shutil.rmtree(tmp_path / name / "llm", ignore_errors=True)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline_stays and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, check=True, timeout=300)
