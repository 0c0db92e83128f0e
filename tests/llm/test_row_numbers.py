"""Rows that were multiplied after their scan, and queries in a session that uses observations."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from confab.llm import common, exact_dedup, lm, near_dedup, queries

SMALL = "/root/testdata/sf0.001"
TEXT = [" ".join(f"{w}{i}" for i in range(30)) for w in "abcdefgh"]


@pytest.fixture(scope="module")
def multiplied(spark, tmp_path_factory):
    """Documents with texts of their own, and two copies, made by ``explode``, a join and a union of two rows of a file."""
    path = str(tmp_path_factory.mktemp("multiplied") / "rows")
    spark.createDataFrame([(0, TEXT[:4]), (1, [*TEXT[4:6], TEXT[0]])], "k long, texts array<string>").coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    exploded = rows.select((F.col("k") * 10).alias("k"), F.posexplode("texts").alias("p", "text")).select((F.col("k") + F.col("p")).alias("doc_id"), "text")
    numbers = spark.range(4).withColumnRenamed("id", "p")
    joined = rows.join(numbers, F.col("p") < F.size("texts")).select((F.col("k") * 10 + F.col("p")).alias("doc_id"), F.expr("texts[p]").alias("text"))
    both = None
    for p in range(4):
        part = rows.filter(F.size("texts") > p).select((F.col("k") * 10 + p).alias("doc_id"), F.col("texts")[p].alias("text"))
        both = part if both is None else both.unionAll(part)
    return {"explode": exploded, "join": joined, "union": both}


@pytest.mark.parametrize("kind", ["explode", "join", "union"])
def test_no_row_is_lost(spark, multiplied, kind):
    docs = multiplied[kind]
    numbered = common.with_row_id(docs)
    assert numbered.count() == numbered.select("rid").distinct().count() == 7
    exact = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs).collect()}
    assert exact == {i: (0, 2) if i in (0, 12) else (i, 1) for i in (0, 1, 2, 3, 10, 11, 12)}
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_copies(docs).collect()) == [0, 1, 2, 3, 10, 11]
    near = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs).collect()}
    assert near == {i: 0 if i == 12 else i for i in exact}
    assert sorted(r.doc_id for r in near_dedup.drop_near_copies(docs).collect()) == [0, 1, 2, 3, 10, 11]
    scores = {r.doc_id: r.n_tokens for r in lm.score(docs, F.col("doc_id") == 3).collect()}
    assert scores == dict.fromkeys(exact, 31)


def test_rows_of_files_keep_their_places(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id > 3").select("doc_id", F.upper("text").alias("text"))
    assert common._rows_of_files(docs) and not common._rows_of_files(docs.unionAll(docs)) and not common._rows_of_files(docs.sample(True, 2.0))


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n[:4] in ("op1_", "op6_", "op11")])
def test_models_under_observation(spark, name):
    seen = Observation()
    queries.QUERIES[name](spark, SMALL).observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] > 0


def test_scratch_belongs_to_its_thread(spark):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    together = Barrier(2)

    def work(k):
        with common.scratch(spark):
            stored = common.store(spark.range(k), "t")
            together.wait(60)
            if k == 1:
                return "left"
            import time

            time.sleep(2)
            return stored.count()

    with ThreadPoolExecutor(2) as pool:
        assert sorted(map(str, pool.map(work, [1, 5]))) == ["5", "left"]
