"""The training-data queries against their SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from comparing import DATA, agree  # noqa: E402
from lumenfold.llm.queries import ORACLES, QUERIES  # noqa: E402

FOLDER = f"{DATA}/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_sql_agree(spark, name):
    assert agree(spark, name, QUERIES[name], ORACLES[name], FOLDER) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
