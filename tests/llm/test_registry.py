"""What holds for every query of the subpackage."""

import pytest

from tidewatch.llm import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_counting_sees_what_collecting_sees(spark, name):
    """A plan whose columns the planner can prune must not lose rows by it."""
    df = registry.QUERIES[name](spark, DIR)
    rows = df.collect()
    assert df.count() == len(rows) > 0
    first = df.columns[0]
    assert df.select(first).where(df[first].isNotNull()).count() == sum(r[0] is not None for r in rows)
