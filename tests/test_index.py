"""Questions answered from the stored index, against the same questions over the texts."""

import random

import pytest
from pyspark.sql import functions as F

from confab.operators import context, index
from confab.schemas import MESSAGE

WORDS = ["cat", "concat", "cats", "dog", "the", "I", "一二", "北京大学", "大学", "café", "teria", "a1", "x_y", "!!!", "12:30", "and"]


@pytest.fixture(scope="module")
def chats(spark, tmp_path_factory):
    rng, rows = random.Random(8), []
    for c in range(14):
        place = -1
        for i in range(rng.randint(1, 25)):
            place += rng.choice([1, 1, 1, 3])
            text = rng.choice([" ", "", "-"]).join(rng.choice(WORDS) for _ in range(rng.randint(0, 6)))
            rows.append((f"/out/chat_{c}.json", place, rng.choice([f"Cat {c}", f"Room {c}", None]) if c == 3 else f"Room {c % 4}", rng.choice(["Dog", None, "amy"]), rng.choice([None, "12:30"]), text, rng.choice(["text", "image"])))
    path = str(tmp_path_factory.mktemp("store") / "m")
    spark.createDataFrame(rows, MESSAGE).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


QUESTIONS = ["cat", "the cat", "cat dog", "oncat", "北京大学", "京大", "二", "!!!", "I", "café", "caféteria", "Room 3", "chat_3.json", "12:30", "x", "nothing of it", "a1 x_y and the dog", "é", "cat-dog"]


@pytest.mark.parametrize("part", range(4))
def test_same_scores_as_over_texts(spark, chats, tmp_path, part):
    path = str(tmp_path / "index")
    first = F.pmod(F.xxhash64("source_path"), F.lit(2)) == 0
    assert index.add_sources(chats.filter(first | (F.col("msg_index") > 2)).withColumn("content", F.when(first, F.col("content")).otherwise("cat cat old")), path) == 0
    assert index.add_sources(chats.filter(~first), path) == 1
    for i, question in enumerate(QUESTIONS[part::4]):
        window, options = i % 3, [{}, {"type_": "text"}, {"chats": ["chat_1", "Room 2"]}][i % 3]
        terms, phrase = context.question_terms(spark, question), question.strip().lower()
        want = context.score_context(context.context_windows(chats, window, options.get("chats"), options.get("type_")), question)
        rows, stats = index.counted_windows(index.Index(spark, path), chats, question, terms, window, **options)
        got = context.scored(rows, stats, terms, phrase)
        flat = lambda df: sorted((r.source_path, r.center_index, r.chat_name or "", round(r.score, 9), ",".join(r.matched_terms)) for r in df.collect())
        assert flat(got) == flat(want), question


def test_same_answers(spark, chats, tmp_path):
    path = str(tmp_path / "index")
    index.add_sources(chats, path)
    for question in ("the cat", "北京大学 dog"):
        assert index.ask_index(path, chats, question, k=4).collect() == context.ask(chats, question, k=4).collect()
    with pytest.raises(ValueError):
        index.ask_index(str(tmp_path / "none"), chats, "cat")


def test_a_question_reads_its_terms_and_no_text(spark, chats, tmp_path):
    path = str(tmp_path / "index")
    index.add_sources(chats, path)
    rows, _ = index.counted_windows(index.Index(spark, path), chats, "cat", ["cat"], 2)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    of_terms = index.Index(spark, path).postings(["dog"])
    plan = of_terms._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters")[1].split("]")[0]


def test_a_part_that_is_not_whole_does_not_count(spark, chats, tmp_path):
    path = str(tmp_path / "index")
    index.add_sources(chats, path)
    before = index.ask_index(path, chats, "the cat").collect()
    chats.limit(1).withColumn("head", F.lit("x")).write.parquet(f"{path}/heads/part=1")  # a writer died here
    assert index.ask_index(path, chats, "the cat").collect() == before
    assert index.add_sources(chats.limit(0), path) == 1
