"""Ties at the threshold of the importance resampling."""

import pytest

from tracewise.llm import importance
from tracewise.llm.common import stored


@pytest.mark.parametrize("k,want", [(1, (9.0, 7)), (2, (5.0, None)), (3, (5.0, 1)), (900, (5.0, 1)), (1003, (5.0, 2)), (1004, (1.0, 3))])
def test_threshold_counts_tied_rows(spark, k, want):
    rows = [(9.0, 7), (5.0, None)] + [(5.0, 1)] * 1000 + [(5.0, 2), (1.0, 3)]
    keys = stored(spark.createDataFrame(rows, "gumbel_key double, doc_id long"), "test-ties")
    assert importance.threshold(keys, k) == want
