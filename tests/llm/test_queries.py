"""The registered queries on the smallest tables, and that the rest of the library does without this package."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from mlquarry.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import DATA, duck, plain  # noqa: F401

ROOT = Path(__file__).resolve().parents[2]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):  # noqa: F811
    rows = QUERIES[name](spark, DATA).collect()
    if name in ORACLE_SQL:
        cursor = duck.execute(ORACLE_SQL[name])
        order = sorted(d[0] for d in cursor.description)
        names = [d[0] for d in cursor.description]
        want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall()), key=repr)
        assert sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr) == want


def test_the_rest_imports_without_this_package(tmp_path):
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') and k[2].isdigit() for k in q), 'pipeline' in q, len(e.oracle_sql()))"], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    n, ops, pipeline, sql = said.stdout.split()
    assert int(n) > 100 and ops == pipeline == "False" and int(sql) > 80, said.stderr
