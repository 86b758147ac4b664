"""The entry module: what may be missing, and queries that run beside each other."""

import os
import shutil
import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def entry_of(folder):
    return subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=folder, capture_output=True,
                          text=True, env={**os.environ, "PYTHONPATH": ""})


@pytest.fixture
def copy(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "riskframe"):
        src = os.path.join(REPO, name)
        if os.path.isdir(src):
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(REPO, "__spark_entry__.py"), tmp_path)
    return tmp_path


def test_entry_works_without_the_corpus_operators(copy):
    out = entry_of(copy)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[0]) > 150


def test_a_broken_part_is_an_error(copy):
    (copy / "riskframe" / "llm").mkdir()
    (copy / "riskframe" / "llm" / "__init__.py").write_text("")
    (copy / "riskframe" / "llm" / "oracle.py").write_text("import a_package_that_is_not_there\nORACLE_SQL = {}\n")
    out = entry_of(copy)
    assert out.returncode != 0 and "a_package_that_is_not_there" in out.stderr


def test_queries_in_threads_keep_their_own_tables(spark):
    from riskframe.catalog import queries
    q = queries()
    with ThreadPoolExecutor(3) as ex:
        got = list(ex.map(lambda k: q[k](spark, "/root/testdata/sf0.001").collect(), ["M8", "M16", "M8"]))
    assert got[0] == got[2] and all(got)


def test_package_archive(spark, monkeypatch):
    import zipfile
    from riskframe import session
    sent = []
    monkeypatch.setattr(spark.sparkContext, "addPyFile", sent.append)
    session.ship_package(spark)
    names = zipfile.ZipFile(sent[0]).namelist()
    assert "riskframe/session.py" in names and "riskframe/operators/boosting.py" in names
