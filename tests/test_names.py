"""Name matching: all pairs judged by the rules, against the joins; and work that grows with names and matches."""

import random

import pytest
from pyspark.sql import functions as F

from confab.operators import names as N

RULES = {
    "plain": N.names_match, "strict": N.names_match_strict, "combined": N.combined_match,
    "titles": lambda: N.titles_match(F.col("v_title"), F.col("c_title"), F.col("v_title_core"), F.col("c_title_core")),
}


def listed(spark, rows, name):
    return spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"v int, {name} string").withColumnRenamed("v", f"{name}_at")


def odd_names(rng, n):
    words = ["Team", "team", "Ops", "北京", "北京大学", "校友群", "a", "Ab", "x", "Customer#00", "Customer#01", "Flat", "🙂", "·", " ", "…", "...", "(12)", "-", "_", "9", "12", "ß", "Ａ", "aaa"]
    return [*["".join(rng.choice(words) for _ in range(rng.randint(0, 5))) for _ in range(n)], None, "", " ", "…"]


@pytest.mark.parametrize("rule", list(RULES))
def test_joins_find_what_judging_all_pairs_finds(spark, rule):
    rng = random.Random(hash(rule) % 7)
    seen = odd_names(rng, 220)
    asked = [*odd_names(rng, 60), *[x[: rng.randint(1, 6)] for x in seen[:40] if x], *[x + "tail" for x in seen[40:60] if x], *seen[:9]]
    v, c = listed(spark, seen, "name"), listed(spark, asked, "configured")
    got = N.match_names(v, c, rule=rule).select("name_at", "configured_at").collect()
    judged = N.with_keys(v, "name", "v_").crossJoin(N.with_keys(c, "configured", "c_")).filter(RULES[rule]()).select("name_at", "configured_at").collect()
    assert len(got) == len(set(got)) and set(got) == set(judged) and len(judged) > 30


def forms(spark, n, prefix, shift=0):
    name = F.format_string("Customer#%09d", F.col("id") + shift)
    return N.with_keys(spark.range(n).select(name.alias("name")), "name", prefix)


@pytest.mark.parametrize("rule", ["plain", "strict", "combined"])
def test_names_of_one_stem_meet_only_their_matches(spark, rule):
    v, c = forms(spark, 3000, "v_"), forms(spark, 3000, "c_", 1500)
    keys = {"plain": N._plain_keys, "strict": N._strict_keys, "combined": lambda: [*N._strict_keys(), *N._aligned_keys()]}[rule]()
    assert N.matching_pairs(v, c, rule).count() == 1500
    assert N._meeting(v, c, keys).count() <= 4 * 1500


def test_titles_of_one_stem_meet_few_others(spark):
    v, c = forms(spark, 3000, "v_"), forms(spark, 3000, "c_", 1500)
    assert N.matching_pairs(v, c, "titles").count() == 1500
    assert N._title_pairs(v, c).count() <= 4 * 1500
    a, b = N._title_forms(v, "v_"), N._title_forms(c, "c_")
    # no two names of one word and different numbers meet, in any step
    assert N._alike(a, "v_", b, "c_", True).count() == 1500 and N._within(a, "v_", b, "c_").count() == 0


def test_columns_of_any_name_stay(spark):
    v = spark.createDataFrame([("Team A", 1, "k")], "name string, c int, key string")
    c = spark.createDataFrame([("Team A", "Team A", 2), ("Team A", "x", 3)], "configured string, v string, __b int")
    got = N.match_names(v, c, rule="plain")
    assert got.columns == ["name", "c", "key", "configured", "v", "__b"] and got.count() == 2


def test_many_pairs_are_not_collected(spark, monkeypatch):
    v, c = listed(spark, ["Team A", "Team B", "Team"] * 4, "name"), listed(spark, ["Team A", "Team B", "Team AB"], "configured")
    few = sorted(map(tuple, N.match_names(v, c).collect()))
    monkeypatch.setattr(N, "BROADCAST_PAIRS", 0)
    assert sorted(map(tuple, N.match_names(v, c).collect())) == few


def test_resolved_names_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([("s1", 3, "Team A", None, None), ("s1", 1, "Team A…", None, None), ("s2", 0, "Other", "2", True)], "scan_id string, row_pos int, name string, badge_text string, is_group boolean")
    asked = spark.createDataFrame([(f"Name {i}", i) for i in range(9)] + [("Team A", 9), ("Other", 10)], "configured string, position int")
    monkeypatch.setattr(N, "NAME_BLOCK", 2)
    got = {(r.scan_id, r.configured): r.row_pos for r in N.resolved_chats(rows, asked).collect()}
    assert len(got) == 22 and {k: p for k, p in got.items() if p is not None} == {("s1", "Team A"): 1, ("s2", "Other"): 0}
    found, missing = N.resolve_chats(rows, asked)
    assert (found.count(), missing.count()) == (2, 20)


def test_names_first_seen_in_rounds_are_those_of_the_walk(spark, monkeypatch):
    rng = random.Random(6)
    parts = ["Al", "Ali", "Alice", " B", "ce", "北京", "大学", "x", "-", "_", "…", "🙂", "1"]
    rows = [(rng.choice(["a", "a", "a", "b", None]), i // 2, "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))) for i in range(900)]
    df = spark.createDataFrame(rows, "scan_id string, row_pos int, name string").dropDuplicates()
    walked = sorted(map(tuple, N.first_seen(df).collect()), key=repr)
    monkeypatch.setattr(N, "WALK", 200)
    assert sorted(map(tuple, N.first_seen(df).collect()), key=repr) == walked and len(walked) > 30
    chain = spark.createDataFrame([("s", i, "abcdefghijkl"[: 12 - i]) for i in range(10)], "scan_id string, row_pos int, name string")
    monkeypatch.setattr(N, "WALK", 0)
    assert [r.name for r in N.first_seen(chain).collect()] == ["abcdefghijkl"]
