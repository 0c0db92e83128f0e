"""Golden rows and properties of the operators."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from confab.functions import timeparse as P
from confab.operators import clean, context, extract, model, names, ocr, report, runs
from confab.operators import search as S
from confab.operators.fold import Window, lookback_step, similar_step, through, voice_step
from confab.schemas import CHATROW, MESSAGE, OCRLINE, RESPONSE
from confab.sources import messages as src
from confab.sources import sinks


def msgs(spark, rows, source="a"):
    """rows: (sender, time, content, type)"""
    return spark.createDataFrame([(source, i, source, *r) for i, r in enumerate(rows)], MESSAGE)


def back(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.orderBy("source_path", "msg_index").collect()]


def test_dedup(spark):
    m = msgs(spark, [("A", None, "hi", "text"), ("A", "10:00", "hi", "text"), ("B", None, "x", "text"), ("A", None, "hi", "text")])
    assert back(clean.dedup_adjacent(m), "sender", "time") == [("A", "10:00"), ("B", None), ("A", None)]
    assert back(clean.dedup_lookback(m), "sender", "time") == [("A", "10:00"), ("B", None)]
    assert back(clean.dedup_exact(m), "msg_index") == [0, 1, 2]
    far = msgs(spark, [("k", None, "k", "text"), *[("o", None, str(i), "text") for i in range(5)], ("k", None, "k", "text")])
    assert clean.dedup_lookback(far).count() == 7
    once = clean.dedup_lookback(m)
    assert back(clean.dedup_lookback(once), "msg_index") == back(once, "msg_index")


def test_voice(spark):
    m = msgs(spark, [("A", None, '[语音] 2"', "voice"), ("A", None, '2"', "text"), ("A", None, '2"', "text"), ("B", None, '2"', "text")])
    assert back(clean.drop_voice_durations(m), "msg_index") == [0, 3]


def test_similar_and_postprocess(spark):
    ad = "A very long advertisement about nothing at all, number "
    m = msgs(spark, [("A", None, ad + "1", "text"), ("A", "9:00", ad + "2", "text"), ("B", None, ad + "3", "text"), ("A", None, "Missed", "text"), ("A", None, "12:30", "text"), ("A", None, "  ", "text")])
    assert back(clean.dedup_similar(m), "msg_index", "time")[:2] == [(0, "9:00"), (2, None)]
    done = clean.postprocess(m)
    assert back(done, "msg_index", "type", "content")[1:] == [(2, "text", ad + "3"), (3, "call", "[通话] Missed")]


def test_fold_is_independent_of_partitions(spark):
    rng = random.Random(3)
    rows = [(f"c{rng.randrange(6)}", i, "n", rng.choice("ab"), rng.choice([None, "1:00"]), rng.choice("xyz"), "text") for i in range(300)]
    want = []
    for c in sorted({r[0] for r in rows}):
        chain = [Window(lookback_step(), 5)]
        own = [dict(zip(MESSAGE_COLUMNS, r, strict=True)) for r in rows if r[0] == c]
        want += [(r["source_path"], r["msg_index"], r["time"]) for r in through(chain, own, end=True)]
    for n in (1, 3, 8):
        got = clean.dedup_lookback(spark.createDataFrame(rows, MESSAGE).repartition(n))
        assert back(got, "source_path", "msg_index", "time") == sorted(want, key=lambda r: r[:2])


MESSAGE_COLUMNS = [c.split()[0] for c in MESSAGE.split(", ")]


def test_steps_alone():
    row = {"sender": "a", "content": "x" * 40, "type": "text", "time": None}
    assert similar_step()([dict(row)], dict(row)) is False
    assert similar_step()([dict(row)], row | {"type": "image"}) is True
    assert voice_step()([], row) is True


def test_recent_window(spark):
    now = F.lit("2026-04-10 12:00:00").cast("timestamp_ntz")
    m = P.with_effective_time(msgs(spark, [("A", "昨天 11:30", "1", "text"), ("A", "昨天 13:30", "2", "text"), ("A", None, "3", "text")]), now, ["source_path"], ["msg_index"])
    assert back(P.recent_window(m, 24, now), "content") == ["2", "3"]
    assert P.recent_window(m, 0, now).count() == 3


def answers(spark, rows):
    """rows: (chat_name, chunk_index, text)"""
    full = [("r", i, f"s{i}", c, k, None, "message_extraction", False, t) for i, (c, k, t) in enumerate(rows)]
    return spark.createDataFrame(full, RESPONSE)


def item(sender, content, time=None, type="text"):
    return {"sender": sender, "content": content, "time": time, "type": type}


def test_extract_chat(spark):
    now = F.lit("2026-04-10 12:00:00").cast("timestamp_ntz")
    first = json.dumps({"messages": [item(None, "lost"), item(None, "16:15"), item("AARON", "a"), item("You", "b")]})
    again = "Sure:\n```json\n" + json.dumps({"messages": [item("AARON", "a", "16:15"), item(None, "pulled", type="recalled")]}) + "\n```"
    out = extract.extract_chat(answers(spark, [("C", 0, first), ("C", 1, again), ("D", 0, "none")]), now)
    assert back(out, "sender", "content", "time") == [("AARON", "a", "16:15"), ("You", "b", "16:15"), (None, "pulled", None)]
    assert back(extract.extract_chat(answers(spark, [("C", 0, first)]), now, max_messages=1), "sender") == ["You"]


def test_finalize(spark):
    now = F.lit("2026-04-10 12:00:00").cast("timestamp_ntz")
    good = json.dumps({"messages": [item("A", "past", "2000-01-01 10:00"), item("A", "future", "2999-01-01 10:00")]})
    rows, summary = extract.finalize(answers(spark, [("C", 0, good), ("C", 1, "not json"), ("C", 2, ""), ("C", 3, good), ("C", 4, json.dumps({"messages": [], "threads": [{"name": "x"}]}))]), now, hours=24)
    assert [r.content for r in rows.collect()] == ["future"]
    s = summary.first()
    assert (s.total, s.completed, s.missing, s.failed, s.messages_before, s.messages_in_window, s.ok) == (5, 3, "s2", "s1", 4, 2, False)


def test_chat_names_carry(spark):
    r = answers(spark, [(None, 0, json.dumps({"chat_name": "X", "messages": [item("A", "1")]})), (None, 1, json.dumps({"messages": [item("A", "2")]})), (None, 2, json.dumps({"chat_name": "Y", "messages": [item("A", "3")]}))])
    rows, _ = extract.finalize(r, F.lit("2026-04-10 12:00:00").cast("timestamp_ntz"))
    assert {x.content: x.chat_name for x in rows.collect()} == {"1": "X", "2": "X", "3": "Y"}


def plain_scores(rows, question, w):
    """The ranking's definition in plain Python."""
    toks = lambda t: [x for x in re.findall(r"[a-z0-9_]+", t.lower()) if len(x) > 1]
    terms = list(dict.fromkeys(toks(question)))
    chats = {}
    for r in rows:
        chats.setdefault(r[0], []).append(r)
    cand = []
    for s, own in chats.items():
        own.sort(key=lambda r: r[1])
        for i, r in enumerate(own):
            near = own[max(0, i - w) : i + w + 1]
            cand.append((s, r[1], "\n".join([r[2], s, *("\n".join(x or "" for x in (m[2], m[3], m[4], m[5], m[6])) for m in near)])))
    df = {t: sum(t in toks(c[2]) for c in cand) for t in terms}
    out = {}
    for s, i, text in cand:
        tk, matched, score = toks(text), set(), 0.0
        if question.lower().strip() in text.lower():
            score, matched = 20.0, {question.lower().strip()}
        for t in terms:
            if t in tk:
                score += tk.count(t) * (math.log((1 + len(cand)) / (1 + df[t])) + 1)
                matched.add(t)
        if terms:
            cover = len(matched & set(terms)) / len(terms)
            score = score * (1 + cover) + 5 * (cover == 1)
        if score > 0:
            out[s, i] = round(score, 6)
    return out


def test_ask_equals_plain_python(spark):
    rng = random.Random(5)
    words = ["art", "party", "lunch", "noon", "client", "call"]
    rows = [(f"c{c}", i, f"c{c}", rng.choice("ab"), None, " ".join(rng.choices(words, k=3)), "text") for c in range(4) for i in range(7)]
    m = spark.createDataFrame(rows, MESSAGE)
    for q in ("lunch call", "art", "zzz lunch"):
        got = context.score_context(context.context_windows(m, 1), q)
        assert {(r.source_path, r.center_index): round(r.score, 6) for r in got.collect()} == plain_scores(rows, q, 1)
    best = context.ask(m, "lunch call", k=3, window=1).collect()
    assert [r["rank"] for r in best] == [1, 2, 3]
    assert all(len(r.messages) in (2, 3) for r in best)
    picks = [(r.source_path, r.center_index) for r in best]
    assert all(a == b or a[0] != b[0] or abs(a[1] - b[1]) > 1 for a in picks for b in picks)


def test_part_of_a_word_counts_as_covered(spark):
    m = msgs(spark, [("A", None, "a party", "text")])
    assert [r.score for r in context.score_context(context.context_windows(m, 0), "art").collect()] == [45.0]


def test_names(spark):
    def hit(visible, configured, rule):
        v, c = spark.createDataFrame([(visible,)], "name string"), spark.createDataFrame([(configured,)], "configured string")
        return names.match_names(v, c, rule=rule).count() == 1

    long = "运营核心群后半段被隐藏"
    assert hit("运营核心群", long, "strict") and hit("运营核心群…", long, "strict") and not hit("运营", long, "strict")
    assert hit("运营核心群", "运营核心群💗后半段被隐藏", "strict")
    for shown in ("深圳奇鸟科技.", "深圳奇鸟科技", "深圳-奇鸟科技"):
        assert hit(shown, "深圳奇鸟科技有限公司  泓灼财税服务群", "combined")
    assert not hit("运营", long, "combined")
    assert not hit("test-1", "test-2", "titles") and hit("test 2", "test-2", "titles") and not hit("bitter", "test-2", "titles")


@pytest.mark.parametrize("rule", ["plain", "strict", "titles", "combined"])
def test_long_lists_match_as_short_ones(spark, monkeypatch, rule):
    rng = random.Random(4)
    values = ["ALGERIA", "A!", "A!lpha", "x ALGERIA", "项目讨论组", "大项目讨论群", "Team12", "Team13", "abcd…", "abcdef", "ABCDEF", "😀 abcd", "...", "!", "", None, "ab", "a", "abc", "cab", "Group A-B_c", "group ab", "(3)abc"]
    values += ["".join(rng.choices("abAB1 -!.…项目😀", k=rng.randrange(1, 9))) for _ in range(120)]
    visible = spark.createDataFrame([(n,) for n in [*values, "x ALGERIA"]], "name string")
    configured = spark.createDataFrame([(n,) for n in values], "configured string")
    pairs = lambda: sorted((str(r.name), str(r.configured)) for r in names.match_names(visible, configured, rule=rule).collect())
    short = pairs()
    assert len(short) > len(values)
    monkeypatch.setattr(names, "BROADCAST_PAIRS", 0)
    assert pairs() == short


def test_resolve_chats(spark):
    rows = spark.createDataFrame([("s", 0, "Bob", None, False, False, 1), ("s", 1, "Alice", "3", False, False, 2), ("s", 2, "Alice", None, None, False, 3)], CHATROW)
    c = spark.createDataFrame([("Alice", 0), ("Nobody", 1)], "configured string, position int")
    found, missing = names.resolve_chats(rows, c)
    assert [(r.configured, r.row_pos) for r in found.collect()] == [("Alice", 1)] and [r.configured for r in missing.collect()] == ["Nobody"]
    assert names.resolve_chats(rows, c, unread_only=True)[0].count() == 1
    assert [r.row_pos for r in names.resolve_chats(rows, c, kind="group")[0].collect()] == [2]
    assert names.allowed_rows(rows, c.filter("position > 5")).count() == 3
    assert names.allowed_rows(rows, c.filter("position = 0")).count() == 2
    assert names.first_seen(rows.select("scan_id", "row_pos", "name")).count() == 2


def test_ocr(spark):
    a = [("1", "<ref>Top</ref><quad>(10,20),(120,50)</quad>", 300, 200), ("2", "B (10,60),(20,80)\nA (10,20),(120,50)", 300, 200), ("3", "<ref>n</ref><quad>(0.1,0.1),(0.4,0.25)</quad>", 200, 200), ("4", "<ref>Chat</ref><quad>(-5,-5),(200,90)</quad>", 100, 50), ("5", "", 10, 10)]
    out = ocr.parse_ocr_text(spark.createDataFrame(a, "image_id string, text string, width int, height int"))
    got = [(r.image_id, r.text, r.x1, r.y1, r.x2, r.y2) for r in out.orderBy("image_id", "line_pos").collect()]
    assert got == [("1", "Top", 10, 20, 120, 50), ("2", "A", 10, 20, 120, 50), ("2", "B", 10, 60, 20, 80), ("3", "n", 20, 20, 80, 50), ("4", "Chat", 0, 0, 100, 50)]
    lines = spark.createDataFrame([("i", 0, "Name", 5, 0, 50, 10, 1.0), ("i", 1, "preview", 0, 15, 60, 25, 1.0), ("i", 2, "Other", 0, 60, 9, 70, 1.0)], OCRLINE)
    assert [(r.text, r.x1, r.y2) for r in ocr.merge_ocr_rows(lines).orderBy("y1").collect()] == [("Name", 0, 25), ("Other", 0, 70)]


def test_best_text_match(spark):
    def best(lines, target, **how):
        t = spark.createDataFrame([("i", n, x, 0, 0, 1, 1, 1.0) for n, x in enumerate(lines)], OCRLINE)
        got = ocr.best_text_match(t, spark.createDataFrame([("i", target)], "image_id string, target string"), **how).collect()
        return got[0].text if got else None

    assert best(["x", "Operations Team…"], "Operations Team Daily Standup", ellipsis_only=True) == "Operations Team…"
    assert best(["Operations"], "Operations Team Daily Standup", ellipsis_only=True, least=0.95) is None
    assert best(["Daily", "Operation Team Daily Standup"], "Operations Team Daily Standup") == "Operation Team Daily Standup"


def test_titles(spark):
    def pick(texts, hint):
        rows = [("i", n, 0, t, hint) for n, t in enumerate(texts)]
        return ocr.pick_title(spark.createDataFrame(rows, "image_id string, band int, pos int, text string, hint string")).first().title

    assert pick(["这一行很长很长很长很长很长，是聊天里的内容而不是标题", "涛涛弟弟"], "无关") == "涛涛弟弟"
    assert pick(["这一行很长很长很长很长很长，是聊天里的内容而不是标题", "涛涛弟弟"], "涛涛弟") == "涛涛弟弟"
    assert pick(["咋尺VQLZ"], "无关的名字") == ""
    assert pick(["+12", "Team"], "") == "Team"


def test_report(spark):
    m = msgs(spark, [("Alice", "10:15", "hi", "text"), (None, None, "joined", "system")])
    text = report.report_prompt(m).first().prompt
    assert "- 10:15 | Alice: hi\n- 时间未知 | System [system]: joined" in text


def test_sources(spark, tmp_path):
    ok = [{"chat_name": "A", "sender": "x", "time": None, "content": "c", "type": "poll"}]
    for name, value in (("ok", ok), ("obj", {"a": 1}), ("miss", [{"sender": "x"}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    (tmp_path / "bad.json").write_text("[{")
    assert [(r.msg_index, r.type) for r in src.read_messages(spark, f"{tmp_path}/ok.json").collect()] == [(0, "unsupported")]
    for name in ("obj", "miss", "bad"):
        with pytest.raises(Exception, match="not an array"):
            src.read_messages(spark, f"{tmp_path}/{name}.json").collect()
    assert src.read_messages(spark, str(tmp_path), "lenient").count() == 2
    (tmp_path / "env").mkdir()
    (tmp_path / "env" / "e.json").write_text(json.dumps({"chat_name": "A", "message_count": 1, "messages": ok}))
    assert src.read_messages(spark, f"{tmp_path}/env", "envelope").count() == 1
    manifest = {"run_id": "now", "tasks": [{"step_id": "1", "run_id": "now", "response_file": "/x/1.txt"}, {"step_id": "2", "run_id": "old", "response_file": "/x/2.txt"}, {"step_id": "3", "response_file": "/x/3.txt"}]}
    tasks = src.read_tasks(spark.createDataFrame([(json.dumps(manifest),)], "value string"), spark.createDataFrame([("1.txt", "hi"), ("3.txt", " ")], "file_name string, response_text string"))
    assert {r.step_id: r.response_text for r in tasks.collect()} == {"1": "hi", "3": None}


def test_sinks(spark, tmp_path):
    m = msgs(spark, [("Al", None, "x", "text"), (None, "1:00", "y", "image")])
    assert json.loads(sinks.chat_arrays(m, F.lit("Label")).first().value)[1] == {"chat_name": "Label", "sender": "", "time": "1:00", "content": "y", "type": "image"}
    e = json.loads(sinks.chat_envelopes(m, "t", {"messages": "no", "k": "v"}).first().value)
    assert (e["message_count"], e["k"], len(e["messages"])) == (2, "v", 2)
    sinks.write_store(m, f"{tmp_path}/store")
    assert spark.read.parquet(f"{tmp_path}/store").count() == 2
    sinks.write_tasks(sinks.task_rows(spark.createDataFrame([("c", 1)], "chat_name string, chunk_index int"), "r"), f"{tmp_path}/tasks")
    sinks.write_text(sinks.transcripts(m, "now"), f"{tmp_path}/text")
    sinks.append_run(spark.createDataFrame([(True, "t")], "ok boolean, finished_at_utc string"), f"{tmp_path}/runs")


def test_runs_and_model(spark):
    o = spark.createDataFrame([("r", 0, "A", "p", None, None), ("r", 1, "B", None, "model", "late"), ("r", 2, "B", None, "model", "late")], "run_id string, pos int, chat_name string, path string, stage string, error string")
    s = runs.run_status(o).first()
    assert (s.status, s.ok, s.n_failures, s.errors) == ("partial", False, 1, "B: model: late")
    t = spark.createDataFrame([("1", "p", None, 5), ("2", "boom", None, 5)], "step_id string, prompt string, image binary, max_tokens int")

    def query(prompt, image, n):
        if prompt == "boom":
            raise RuntimeError("no")
        return "fine"

    got = {r.step_id: (r.response_text, r.error) for r in model.map_model(t, query, workers=2).collect()}
    assert got == {"1": ("fine", None), "2": (None, "RuntimeError: no")}
    done = spark.createDataFrame([("1", "x"), ("2", " ")], "step_id string, response_text string")
    assert [r.step_id for r in model.pending_tasks(t, done).collect()] == ["2"]
    assert model.pending_tasks(t, done, force=True).count() == 2 and model.pending_tasks(t, done, force=True, skip_existing=True).count() == 1


def test_history_of_nothing(spark):
    assert S.history(msgs(spark, [("A", None, "x", "text")]), chat="none").count() == 0
    assert S.search(msgs(spark, [("A", None, None, "text")]), "x").count() == 0
