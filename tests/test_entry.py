import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
TABLES = Path("/root/testdata/sf0.001")


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_without_the_training_data_part(tmp_path):
    for p in ("__spark_entry__.py", "fairlead"):
        subprocess.run(["cp", "-r", ROOT / p, tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "fairlead" / "llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'r6_encounters' in q and not any(n.startswith('op') for n in q), q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


@pytest.mark.skipif(not TABLES.exists(), reason="no tables here")
def test_the_flagship_query_has_rows(spark):
    assert entry.entry(spark).count() == 2
