import subprocess
import sys
from pathlib import Path

import pytest
from oracle import compare

from sensorloom.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), ORACLE_SQL[name], SF) > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert not e.entry(spark).isEmpty()
    assert set(e.oracle_sql()) <= set(e.queries())


def test_scan_is_pruned(spark):
    plan = QUERIES["tumbling_stats"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "PushedFilters: [IsNotNull(ts)" in plan and "Python" not in plan


@pytest.mark.parametrize("hidden", ["xxhash", "sensorloom.llm", "corpus_pipeline"])
def test_core_queries_without_the_rest(hidden):
    """In a process of its own in which a module can't be imported."""
    code = f"import sys; sys.modules[{hidden!r}] = None; import __spark_entry__ as e; names = set(e.queries()); assert 'tumbling_stats' in names and 'pipeline' not in names and set(e.oracle_sql()) <= names"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)
