"""Golden rows of the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from confab.functions import text as T
from confab.functions import timeparse as P


def one(spark, values, column):
    kind = "string"
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", column(F.col("v")).alias("o")).orderBy("i").collect()]


def test_times(spark):
    def at(text, now):
        return spark.createDataFrame([(text,)], "t string").select(P.parse_message_time(F.col("t"), F.lit(now).cast("timestamp_ntz")).alias("o")).first().o

    d = dt.datetime
    assert at("23:30", "2026-04-10 00:15:00") == d(2026, 4, 9, 23, 30)
    assert at("昨天 21:10", "2026-04-10 10:00:00") == d(2026, 4, 9, 21, 10)
    assert at("星期四 09:10", "2026-04-10 10:00:00") == d(2026, 4, 9, 9, 10)
    assert at("下午 3：05", "2026-04-10 18:00:00") == d(2026, 4, 10, 15, 5)
    assert at("12:05 am", "2026-04-10 18:00:00") == d(2026, 4, 10, 0, 5)
    assert at("2025/12/31 08:00", "2026-04-10 18:00:00") == d(2025, 12, 31, 8, 0)
    assert at("12月31日 08:00", "2026-04-10 18:00:00") == d(2025, 12, 31, 8, 0)
    assert at("周五 19:00", "2026-04-10 18:00:00") == d(2026, 4, 3, 19, 0)
    assert at("今天 09:10", "2026-04-10 10:00:00") == d(2026, 4, 10, 9, 10)
    for bad in (None, "", "hello", "25:00", "13月40日 08:00"):
        assert at(bad, "2026-04-10 10:00:00") is None


def test_tokens(spark):
    assert one(spark, ["明天", "a", "k9", None, "明天中午"], T.tokenize) == [["明", "天", "明天"], [], ["k9"], [], ["明", "天", "中", "午", "明天", "天中", "中午", "明天中", "天中午"]]


def test_names(spark):
    assert one(spark, ["a:b/c", " ", None, "群💗. "], T.safe_file_key) == ["a_b_c", "chat", "chat", "群💗"]
    assert one(spark, ["99+", "", "…", "500", None], T.badge_cap) == [99, 1, 1, 200, 1]
    cleaned = one(spark, ["22 Chapel and 30M 昨天23", "Chat Team 12:30", "曲亦琳 今天回我", "ISnIM〇LD", "Best Girlsse"], T.clean_ocr_name)
    assert cleaned == ["22 Chapel", "Chat Team", "曲亦琳", "ISnIMOLD", "Best Girls"]
    assert one(spark, ["Ａ…  b💗", None], T.chat_label) == ["A... b", ""]
    assert one(spark, ["test 2（12）", "test-2"], T.normalize_title) == ["test2", "test2"]
    with pytest.raises(ValueError):
        T.chat_kind("nobody")
    assert T.chat_kind("DMs") == "private"


def test_repetition(spark):
    loop, short = "head " + "ab c" * 3000, "ab" * 100
    assert one(spark, [loop, short, None, "x" * 9000], T.trim_repetition) == ["head ab c", short, None, "xx"]


def test_types(spark):
    assert one(spark, [" Photo", "VOIP", "clip", "audio", "document", "poll", "text"], T.normalize_type) == ["image", "call", "video", "voice", "unsupported", "other", "text"]
    assert one(spark, ["file", "call", None], T.coerce_type) == ["file", "unsupported", "unsupported"]


def test_lines(spark):
    line = lambda kind: lambda c: T.render_line(F.lit("10:15"), F.lit("Alice"), F.lit(kind), c)
    assert one(spark, ["hi", None], line("text")) == ["- 10:15 | Alice: hi", "- 10:15 | Alice: (空内容)"]
    quiet = lambda c: T.render_line(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("system"), c)
    assert one(spark, ["joined"], quiet) == ["- 时间未知 | System [system]: joined"]
