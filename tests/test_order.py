"""Places and running sums over ranges, and reports in parts."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confab.operators import order, report
from confab.schemas import MESSAGE


@pytest.mark.parametrize("key", [[], ["k"]])
def test_ranges_sum_as_one_window(spark, monkeypatch, key):
    monkeypatch.setattr(order, "RANGE_ROWS", 40)
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, w int").repartition(7)
    got = order.running(df, key, [F.col("i")], "s", F.col("w"))
    assert got.columns == ["k", "i", "w", "s"]
    before = F.coalesce(F.sum("w").over(W.partitionBy(*key).orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, df.withColumn("s", before).collect()), key=repr)
    assert sorted(r.n for r in order.place_in_order(df, F.struct("k", "i"), "n").collect()) == list(range(500))


def test_parts_are_the_block(spark, monkeypatch):
    monkeypatch.setattr(order, "RANGE_ROWS", 30)
    rng = random.Random(2)
    rows = [(f"p{i % 3}", i, rng.choice(["hot", "hot", "b"]), "s", None, rng.choice(["hi", "早上好" * 40, "x" * rng.randint(0, 3000), ""]), "text") for i in range(200)] + [("p", 0, "one", "s", None, "only", "text")]
    m = spark.createDataFrame(rows, MESSAGE)
    whole = {r.chat_name: r.block for r in report.report_blocks(m).collect()}
    parts = report.report_parts(m, 1000).collect()
    assert all(len(r.block.encode()) <= 1000 for r in parts) and len(parts) > 50
    for chat, block in whole.items():
        mine = sorted((r.part, r.block) for r in parts if r.chat_name == chat)
        assert [n for n, _ in mine] == list(range(len(mine))) and "".join(b for _, b in mine) == block
    assert report.report_parts(m.limit(0), 1000).count() == 0


def test_pages_of_a_store(spark, monkeypatch, tmp_path):
    from confab.operators import search
    from confab.sources import sinks

    monkeypatch.setattr(order, "RANGE_ROWS", 100)
    monkeypatch.setattr(sinks, "PAGE_BLOCK", 50)
    rows = [("hot", 3 * i, "hot", "s", None, f"t{i}", "text") for i in range(700)] + [("b", i, "b", "s", None, f"b{i}", "text") for i in range(5)]
    m = spark.createDataFrame(rows, MESSAGE).repartition(6)
    sinks.write_pages(m, str(tmp_path / "store"))
    wanted = ["source_path", "msg_index", "content", "position", "total"]
    for chat, limit, offset, newest in [("hot", 20, 90, False), ("hot", 20, 90, True), ("hot", 9, 695, False), ("hot", 9, 695, True), ("hot", 5, 900, False), ("b", 9, 0, True), (None, 3, 2, False), ("none", 3, 0, True)]:
        got = search.stored_history(spark, str(tmp_path / "store"), chat, limit, offset, newest).select(*wanted)
        want = search.history(m, chat, None, limit, offset, newest).select(*wanted)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), (chat, limit, offset, newest)
    plan = search.stored_history(spark, str(tmp_path / "store"), "hot", 20, 90)._jdf.queryExecution().executedPlan().toString()
    assert "Sort " not in plan.split("Join")[0] and "block" in plan.split("PartitionFilters: [")[1].split("]")[0]
