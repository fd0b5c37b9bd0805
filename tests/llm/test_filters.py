"""Shared filters stay sharp near their largest size; anchors that agree on one side only with themselves send no windows."""

import numpy as np

from tablewright.llm import filters, substring_dedup


def test_filter_near_its_largest_size(spark, monkeypatch):
    monkeypatch.setattr(filters, "BITS", 20)
    n = 100_000
    f = filters.of_values(spark.range(n))
    assert f.has(np.arange(n, dtype=np.uint64)).all()
    assert f.has(np.arange(n, 4 * n, dtype=np.uint64)).mean() < 0.04


def test_meeting_on_one_side():
    name, side = np.array([1, 1, 1, 1, 2, 2], np.uint64), np.array([7, 7, 9, 0, 7, 7])
    whole, k = np.array([1, 2, 3, 4, 5, 6], np.uint64), np.array([1, 2, 3, 4, 5, 5])
    assert substring_dedup._meet(name, side, whole, k).tolist() == [True, True, False, False, False, False]
