"""Every core query against its SQL on the smallest tables, and the driver's entry points."""

from pathlib import Path

import pytest

from comparing import DATA, agree
from lumenfold.plans import core, curation

FOLDER = f"{DATA}/sf0.001"
QUERIES = core.QUERIES | curation.QUERIES
ORACLES = core.ORACLES | curation.ORACLES

pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_sql_agree(spark, name):
    assert agree(spark, name, QUERIES[name], ORACLES[name], FOLDER) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_scans_read_only_what_a_query_needs(spark):
    plan = curation.orientation_counts(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<photo_id:bigint,width:int,height:int>" in plan and "PushedFilters: [IsNotNull(photo_id)]" in plan
