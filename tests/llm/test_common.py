"""Shared parts of the text operators."""

from tablewright.llm.common import table


def test_heaps_are_collected_before_a_table_is_written(spark):
    """A heap that only grows takes an executor past its memory after some stages, whatever the size of the data."""
    beans = [b for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if b.getName() in ("G1 Old Generation", "MarkSweepCompact", "PS MarkSweep")]
    full = lambda: sum(b.getCollectionCount() for b in beans)
    assert beans
    before = full()
    assert table(spark.range(10), "some").count() == 10
    assert full() > before
    before = full()
    assert table(spark.range(10), "short-rows", 10).count() == 10  # these are many and small
    assert full() == before
