"""Chats written in bundles and read again."""

import os

import pytest

from confab.plans import registry
from confab.schemas import MESSAGE
from confab.sources import messages as src
from confab.sources import sinks

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["read_strict", "read_lenient", "read_envelopes"])
def test_files_do_not_grow_with_chats(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(registry, "_scratch", lambda spark: str(tmp_path / "files"))
    chats = registry.QUERIES[name](spark, SF).select("source_path").distinct().count()
    made = sum(len([f for f in files if f.startswith("part-")]) for _, _, files in os.walk(tmp_path))
    assert chats > 10 and made <= 4  # the session's shuffle partitions


def test_any_text_comes_back(spark, tmp_path):
    texts = ['a\n"b"\\', "  \r\n\t", "", "😀\x01", "{[", "x" * 100_000]
    rows = [(f"c/{i % 2}\n", i, f"c/{i % 2}\n", "s", None, x, "text") for i, x in enumerate(texts)]
    m = spark.createDataFrame(rows, MESSAGE)
    sinks.write_bundles(sinks.chat_arrays(m), f"{tmp_path}/a")
    for mode in ("strict", "lenient"):
        got = src.read_messages(spark, f"{tmp_path}/a", mode, bundled=True).select("source_path", "content").collect()
        assert sorted(tuple(r) for r in got) == sorted((r[0], r[5]) for r in rows)
    bad = spark.createDataFrame([("x", "[{"), ("y", "[]")], "source_path string, value string")
    sinks.write_bundles(bad, f"{tmp_path}/b")
    assert src.read_messages(spark, f"{tmp_path}/b", "lenient", bundled=True).count() == 0
    with pytest.raises(Exception, match="not an array of complete messages"):
        src.read_messages(spark, f"{tmp_path}/b", bundled=True).collect()
