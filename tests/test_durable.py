"""Shuffle files go with what made them; components are the same by rounds and at once."""

import random

from pyspark.sql import functions as F

from revlens.operators import components as c
from revlens.plans import durable
from revlens.plans.durable import written


def _shuffles(spark):
    """Bytes of the shuffle files that Spark still keeps."""
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (blocks.apply(i) for i in range(blocks.size())) if f.getName().startswith("shuffle_"))


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = _shuffles(spark)
    rows = written(spark.range(20_000).withColumn("x", F.rand(1)).repartition(3, "x").groupBy((F.col("x") * 1000).cast("int").alias("k")).agg(F.sum("id").alias("n")))
    assert rows.agg(F.sum("n")).first()[0] == 19_999 * 10_000
    assert _shuffles(spark) - before < 10_000  # the sum's own


def test_few_edges_are_linked_as_by_rounds(spark, monkeypatch):
    r = random.Random(5)
    edges = [(r.randrange(-300, 300) * 10**15, r.randrange(-300, 300) * 10**15) for _ in range(260)]
    df = spark.createDataFrame(edges, "u long, v long")
    want = {}
    for few in (0, 40, c.FEW):
        monkeypatch.setattr(c, "FEW", few)
        rounds = []
        monkeypatch.setattr(c, "_small_star", lambda e, f=c._small_star, rounds=rounds: rounds.append(1) or f(e))
        got = sorted(map(tuple, c.components(df).collect()))
        assert len({n for n, _ in got}) == len(got)
        want.setdefault("rows", got)
        assert got == want["rows"]
    assert not rounds


def test_a_large_heap_is_collected_after_a_write(spark, monkeypatch):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    monkeypatch.setattr(durable, "HEAP", 0)
    before = full()
    written(spark.range(3))
    assert full() > before
