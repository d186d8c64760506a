import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
WITHOUT = """
import re, sys
import __spark_entry__ as e
assert not any(re.match("op[0-9]", n) or n == "pipeline" for n in e.queries()), "not guarded"
assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100
assert not any(m.startswith("quire.llm") for m in sys.modules)
"""


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "template", "n", "band", "pages"] and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    assert not (tmp_path / "copy" / "quire" / "llm").exists()
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=tmp_path / "copy", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)


AWAY = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.queries()["normalize_text"](spark, "/root/testdata/sf0.001").count() > 0
"""


def test_workers_find_the_package_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    subprocess.run([sys.executable, "-c", AWAY.format(root=str(ROOT))], cwd=tmp_path, env=env, check=True)
