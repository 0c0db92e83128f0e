"""Ranked context windows for a question.

Windows are built on message texts, scored and cut to the few that can be chosen; only then are the messages
themselves fetched, so no shuffle carries copies of them. Document frequencies are counted for the question's terms alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confab.functions.text import tokenize
from confab.operators.search import in_chats


def question_terms(spark, question: str) -> list[str]:
    return spark.range(1).select(F.array_distinct(tokenize(F.lit(question))).alias("t")).first().t


# W1
def context_windows(messages: DataFrame, window: int = 2, chats: list[str] | None = None, type_: str | None = None) -> DataFrame:
    """``source_path, center_index, text``: for each centre message, the text of the messages up to ``window`` places away."""
    fields = [F.coalesce(F.col(c), F.lit("")) for c in ("chat_name", "sender", "time", "content", "type")]
    w = W.partitionBy("source_path").orderBy("msg_index").rowsBetween(-window, window)
    near = F.collect_list(F.concat_ws("\n", *fields)).over(w)
    rows = messages.filter(in_chats(chats, "chat_name", "source_path")).withColumn("__near", near)
    if type_ is not None:
        rows = rows.filter(F.col("type") == type_)
    head = F.concat_ws("\n", F.coalesce("chat_name", F.lit("")), F.element_at(F.split("source_path", r"[\\/]"), -1))
    return rows.select("source_path", "chat_name", F.col("msg_index").alias("center_index"), F.concat_ws("\n", head, F.array_join("__near", "\n")).alias("text"))


# A4, A5
def term_counts(tokens: Column, terms: list[str]) -> Column:
    count = lambda term: F.size(F.filter(tokens, lambda x: x == term))
    return F.array(*map(count, terms))


def document_frequency(counted: DataFrame, terms: list[str]) -> DataFrame:
    """One row: the number of windows, and of those with each term."""
    return counted.agg(F.count("*").alias("n"), *[F.count_if(F.col("counts")[i] > 0).alias(f"df{i}") for i in range(len(terms))])


# L4
def score_context(windows: DataFrame, question: str) -> DataFrame:
    """``windows`` with ``score`` (above 0) and ``matched_terms``."""
    terms = question_terms(windows.sparkSession, question)
    phrase = question.strip().lower()
    has_phrase = F.lower("text").contains(phrase) if phrase else F.lit(False)
    counted = windows.withColumns({"counts": term_counts(tokenize(F.col("text")), terms) if terms else F.array().cast("array<int>"), "phrase": has_phrase}).drop("text")
    return scored(counted, document_frequency(counted, terms), terms, phrase)


def scored(counted: DataFrame, stats: DataFrame, terms: list[str], phrase: str) -> DataFrame:
    """Windows with ``counts`` of the terms and ``phrase``, a flag, with ``score`` (above 0) and ``matched_terms``; ``stats`` is one row of numbers of windows."""
    if not terms:
        found = counted.withColumns({"score": F.when(F.col("phrase"), 20.0).otherwise(0.0), "matched_terms": F.when(F.col("phrase"), F.array(F.lit(phrase))).otherwise(F.array().cast("array<string>"))})
        return found.filter("score > 0").drop("counts", "phrase")
    rows = counted.join(F.broadcast(stats))
    weight = [F.log((F.col("n") + 1) / (F.col(f"df{i}") + 1)) + 1 for i in range(len(terms))]
    base = sum((F.col("counts")[i] * w for i, w in enumerate(weight)), F.when(F.col("phrase"), 20.0).otherwise(0.0))
    matched = F.filter(F.transform(F.arrays_zip(F.array(*map(F.lit, terms)).alias("t"), F.col("counts").alias("c")), lambda x: F.when(x["c"] > 0, x["t"])), lambda x: x.isNotNull())
    matched = F.array_distinct(F.concat(F.when(F.col("phrase"), F.array(F.lit(phrase))).otherwise(F.array().cast("array<string>")), matched))
    # a question of one word that is found as a part of another word counts as that term
    hit = sum(((F.col("counts")[i] > 0) | (F.col("phrase") & F.lit(t == phrase))).cast("int") for i, t in enumerate(terms))
    cover = hit / len(terms)
    score = base * (1 + cover) + F.when(cover == 1, 5.0).otherwise(0.0)
    return rows.withColumns({"score": score, "matched_terms": matched}).filter("score > 0").drop("counts", "phrase", "n", *[f"df{i}" for i in range(len(terms))])


# L5
def select_non_overlapping(scored: DataFrame, k: int = 5, window: int = 2) -> DataFrame:
    """The best k windows of which none has its centre within ``window`` of a better one in the same source.

    A pick hides at most 2 * window others, so the best k * (2 * window + 1) rows are enough: these alone are looked at on the driver."""
    top = scored.orderBy(F.desc("score"), "source_path", "center_index").limit(k * (2 * window + 1)).collect()
    chosen: list = []
    for r in top:
        if len(chosen) < k and all(c.source_path != r.source_path or abs(c.center_index - r.center_index) > window for c in chosen):
            chosen.append(r)
    kind = scored.withColumn("rank", F.lit(1)).schema
    return scored.sparkSession.createDataFrame([(*r, i + 1) for i, r in enumerate(chosen)], kind)


# L6
def ask(messages: DataFrame, question: str, k: int = 5, window: int = 2, chats: list[str] | None = None, type_: str | None = None) -> DataFrame:
    """The best k windows with their messages, scores rounded to three places."""
    if not 1 <= k <= 50 or window < 0 or not question.strip():
        raise ValueError("a question, 1 to 50 results and a window of 0 or more are needed")
    best = select_non_overlapping(score_context(context_windows(messages, window, chats, type_), question), k, window)
    return with_messages(best, messages, window)


def with_messages(best: DataFrame, messages: DataFrame, window: int) -> DataFrame:
    """The chosen windows (at most 50) with their messages; of these, only the chosen sources' are read."""
    sources = [r[0] for r in best.select("source_path").distinct().collect()]
    spans = best.select("source_path", "center_index", F.explode(F.sequence(F.col("center_index") - window, F.col("center_index") + window)).alias("msg_index"))
    found = messages.filter(F.col("source_path").isin(sources)).join(F.broadcast(spans), ["source_path", "msg_index"])
    near = found.groupBy("source_path", "center_index").agg(F.array_sort(F.collect_list(F.struct("msg_index", "sender", "time", "content", "type"))).alias("messages"))
    return best.join(near, ["source_path", "center_index"]).select("rank", "chat_name", "source_path", "center_index", F.round("score", 3).alias("score"), "matched_terms", "messages").orderBy("rank")
