"""The queries against their SQL, and the entry module with and without the subpackage."""

import subprocess
import sys

import pytest

from featherloom.llm import queries
from tests.compare import assert_same
from tests.conftest import ROOT, SMALL


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert_same(queries.queries()[name](spark, SMALL), queries.oracle_sql()[name], SMALL)


def test_ten_operators_and_pipeline():
    import __spark_entry__ as entry

    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert numbers == list(range(1, 11)) and "pipeline" in entry.queries()


def test_entry_without_the_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "featherloom", tmp_path / "featherloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1_') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
