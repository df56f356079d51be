"""The driver's contract, with and without the corpus operators."""

import shutil
import subprocess
import sys

from tests.conftest import ROOT


def names(folder):
    code = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True)
    queries, oracles = done.stdout.splitlines()
    return set(queries.split()), set(oracles.split())


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and {"incident_id", "evidence_count", "score"} <= set(rows[0].asDict())


def test_names():
    queries, oracles = names(ROOT)
    assert oracles <= queries and {"f11_minute_features", "c02_c03_incidents"} <= queries


def test_without_corpus_operators(tmp_path):
    shutil.copytree(f"{ROOT}/sigloom", tmp_path / "sigloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    queries, _ = names(tmp_path)
    assert len(queries) > 60 and not any(x.startswith("op") or x == "pipeline" for x in queries)
    (tmp_path / "sigloom/llm/__pycache__").mkdir(parents=True)
    assert names(tmp_path)[0] == queries
