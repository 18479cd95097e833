import pathlib
import shutil
import subprocess
import sys

import __spark_entry__
from millrace.plans import base

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["channel", "n_orders", "n_lines", "cents"] and df.count() > 0


def test_sql_names_are_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(q.startswith('op') and q[2].isdigit() for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    n, sql, corpus = map(int, said.stdout.split()[-3:])
    assert n == len(base.QUERIES) and sql >= n - 2 and corpus == 0
