import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
q = e.queries()
assert len(q) > 20 and 'pipeline' not in q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()
assert q['station_report'](spark, '/root/testdata/sf0.001').count() == 1
"""


@pytest.mark.parametrize("left", ["nothing", "pipeline file", "caches"])
def test_the_rest_works_without_the_subpackage(tmp_path, left):
    gone = ["llm", ".git", "__pycache__", "spark-warehouse", ".pytest_cache"] + ["corpus_pipeline.py"] * (left == "nothing")
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(*gone))
    if left == "caches":
        os.makedirs(tmp_path / "r/gaugemill/llm/__pycache__")
    subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "r", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "gaugemill")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert "gaugemill.llm" not in f.read(), name
