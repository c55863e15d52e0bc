from __future__ import annotations

import pytest

from compare import both
from conftest import SF
from tidemark.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_same_rows_as_sql(spark, name):
    ours, theirs = both(catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name], SF)
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
