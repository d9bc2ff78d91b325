import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from larkspur import queries

DATA = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[1]


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(queries.ORACLES) == set(queries.QUERIES)


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_core_queries_match_their_sql(spark):
    c = duckdb.connect()
    for t in queries.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    for name, run in queries.QUERIES.items():
        got = run(spark, str(DATA))
        want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)), name
    assert entry.entry(spark).count() == 20


def test_the_rest_works_without_the_training_data_part(tmp_path):
    """A copy without llm and corpus_pipeline.py imports and lists the other queries."""
    import shutil

    shutil.copytree(ROOT / "larkspur", tmp_path / "larkspur", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(queries.QUERIES)), "False"], said.stderr
