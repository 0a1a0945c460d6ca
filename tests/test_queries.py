import os
import subprocess
import sys

import pytest

from tessera.plans.catalog import ORACLES, QUERIES
from tests.conftest import DATA, ROOT
from tests.oracle import connection, differs

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    assert differs(spark, con, QUERIES[name], ORACLES[name], FOLDER) is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_corpus_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and not any(k.startswith('op') for k in e.queries()) and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env={**os.environ, "PYTHONPATH": str(tmp_path / "r")}, check=True)
