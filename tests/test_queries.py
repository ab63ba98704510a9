import os
import subprocess
import sys

import pytest

from compare import same
from conftest import DATA, ROOT
from inkwell.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    same(QUERIES[name](spark, f"{DATA}/sf0.001"), duck.sql(ORACLE_SQL[name]))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_training_data_operators(tmp_path):
    """The entry module and the rest import where those folders are gone."""
    import shutil

    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; assert 'context_window' in e.queries() and not any(k.startswith('op') for k in e.queries()); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=env, check=True)
