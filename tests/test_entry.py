import os

import pytest

import __spark_entry__ as entry
from codeloom.plans import queries as core


def test_names():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and core.FLAGSHIP in q
    assert {n for n in q if n.startswith("p4_")} == {"p4_found", "p4_hierarchy", "p4_descendants"}


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="test tables are not here")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
