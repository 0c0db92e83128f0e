"""Folds of hot chats in segments against a fold over each chat from its first row to its last."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from confab.operators import clean, fold
from confab.schemas import MESSAGE


def talk(seed, sizes, words, repeats):
    """Rows of chats; ``repeats``: how often a line comes again soon."""
    rng, rows = random.Random(seed), []
    for c, n in enumerate(sizes):
        recent = deque(maxlen=9)
        for i in range(n):
            if recent and rng.random() < repeats:
                sender, content, kind = rng.choice(recent)
            else:
                sender, content, kind = rng.choice("ab"), " ".join(rng.choice(words) for _ in range(rng.randint(1, 9))), rng.choice(["text", "text", "voice", "other", "call"])
            if rng.random() < 0.1:
                sender, content, kind = "a", rng.choice(["[语音] 5\"", "5\"", "5秒", "12:30", "[语音] 12:30"]), rng.choice(["voice", "text"])
            recent.append((sender, content, kind))
            rows.append((f"chat{c}", i, f"chat{c}", sender, rng.choice([None, "", f"10:{i % 60:02d}"]), rng.choice([content, None]) if rng.random() < 0.02 else content, kind))
    return rows


def at_once(rows, steps):
    """The steps over each chat, one row after another, with plain lists."""
    for make, size in steps:
        out, step = [], make()
        for chat in dict.fromkeys(r["source_path"] for r in rows):
            kept = []
            for r in (r for r in rows if r["source_path"] == chat):
                if step(kept[-size:], r):
                    kept.append(r)
            out += kept
        rows = out
    return rows


CASES = {
    "lookback": [(fold.lookback_step, 5)],
    "chunks": [(lambda: fold.lookback_step(("sender", "content", "type"), fill=False), 5)],
    "voice": [(fold.voice_step, 1)],
    "similar": [(lambda: fold.similar_step(0.88, 30), 5)],
    "chain": [(fold.voice_step, 1), (fold.lookback_step, 1), (fold.lookback_step, 5), (lambda: fold.similar_step(0.8, 10), 5)],
}


@pytest.mark.parametrize("case", list(CASES))
def test_segments_fold_as_one(spark, case):
    rows = talk(3, [900, 40, 700], "one two three four five six seven eight nine ten".split(), 0.4)
    df = spark.createDataFrame(rows, MESSAGE).repartition(5)
    want = at_once([dict(zip(df.columns, r, strict=True)) for r in rows], CASES[case])
    got = fold.fold(df, ["source_path"], ["msg_index"], CASES[case], hot=100, segment=120).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((tuple(r[c] for c in df.columns) for r in want), key=repr)
    assert len(want) < len(rows)


def test_chats_in_which_every_row_decides_on_the_last(spark):
    """Few lines over and over: what a segment keeps depends on all before it, so segments are folded again and again."""
    rng = random.Random(1)
    rows = [("c", i, "c", "s", None, rng.choice("abcdefg"), "text") for i in range(600)]
    df = spark.createDataFrame(rows, MESSAGE)
    want = at_once([dict(zip(df.columns, r, strict=True)) for r in rows], CASES["lookback"])
    got = fold.fold(df, ["source_path"], ["msg_index"], CASES["lookback"], hot=50, segment=60).collect()
    assert sorted(r.msg_index for r in got) == [r["msg_index"] for r in want]


def test_a_hot_chat_uses_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(fold, "HOT", 1000)
    monkeypatch.setattr(fold, "SEGMENT", 1000)
    n = spark.range(20_000).withColumn("k", F.col("id") % 17)
    df = n.selectExpr("'hot' AS source_path", "cast(id AS int) AS msg_index", "'hot' AS chat_name", "'s' AS sender", "cast(null AS string) AS time", "cast(k * k AS string) AS content", "'text' AS type")
    out = clean.dedup_lookback(df)
    assert out.count() == 20_000 and out.select(F.spark_partition_id()).distinct().count() > 1
    assert clean.dedup_lookback(df.limit(0)).count() == 0


def test_null_keys_and_equal_places(spark, monkeypatch):
    rows = [(None, i // 3, None, "s", None, f"w{i % 4}", "text") for i in range(300)] + [("b", i, "b", "s", None, "x", "text") for i in range(50)]
    df = spark.createDataFrame(rows, MESSAGE)
    plain = clean.merge_chunks(df, order=["msg_index", "content"]).collect()
    monkeypatch.setattr(fold, "HOT", 20)
    monkeypatch.setattr(fold, "SEGMENT", 40)
    assert sorted(map(tuple, clean.merge_chunks(df, order=["msg_index", "content"]).collect()), key=repr) == sorted(map(tuple, plain), key=repr)


def test_similar_sentences_against_all_comparisons(spark):
    """Every sentence compared with the last five that stayed, by difflib alone."""
    import difflib

    from confab.plans import registry

    sf = "/root/testdata/sf0.001"
    chats = {}
    for r in registry.sentences(spark, sf).orderBy("source_path", "msg_index").collect():
        chats.setdefault(r.source_path, []).append(r)
    want = set()
    for chat, rows in chats.items():
        kept = []
        for r in rows:
            new = " ".join(r.content.split())
            alike = any(k.sender == r.sender and len(" ".join(k.content.split())) >= 30 and difflib.SequenceMatcher(None, new, " ".join(k.content.split())).ratio() >= 0.88 for k in kept[-5:])
            if len(new) < 30 or not alike:
                kept.append(r)
                want.add((chat, r.msg_index))
    got = {(r.source_path, r.msg_index) for r in registry.QUERIES["dedup_similar_sentences"](spark, sf).collect()}
    assert got == want and len(want) < sum(map(len, chats.values())) - 50
