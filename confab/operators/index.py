"""A stored index for questions: postings of terms by message, so that a question reads its own terms' postings and no text.

The text of a window is that of its messages, line by line, and of a head with the chat's name and file. Terms never cross lines, so a window's counts are sums over its
messages, and postings are kept once for each message, whatever the window. Tables, in parts, of which a source's last one holds:

* ``postings``: term, source, position of the message in its source (-1: in the head), how often; in buckets by the term's hash, sorted by term in each file
* ``places``: the messages without their texts: source, position, index, chat, type
* ``heads``: a source's head, in lower case
* ``vocabulary``: distinct terms, for phrases that begin or end within a word
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confab.functions.text import tokenize
from confab.operators.context import question_terms, scored, select_non_overlapping, with_messages
from confab.operators.search import in_chats

#: Buckets of terms; sources up to this many are named in the filter of a read of messages.
BUCKETS, NAMED_SOURCES = 16, 200
SCHEMAS = {
    "postings": "term string, source_path string, of_chat string, pos int, n int, part int, bucket int",
    "places": "source_path string, pos int, msg_index int, chat_name string, type string, part int",
    "heads": "source_path string, chat_name string, head string, part int",
    "vocabulary": "term string, part int",
}
FIELDS = ["chat_name", "sender", "time", "content", "type"]


def _lines() -> Column:
    return F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in FIELDS])


def _head() -> Column:
    return F.concat_ws("\n", F.coalesce("chat_name", F.lit("")), F.element_at(F.split("source_path", r"[\\/]"), -1))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _parts(spark: SparkSession, path: str) -> list[int]:
    """The parts that are whole: their places are written last."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    root = at(f"{path}/places")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("part=")]
    return sorted(int(p.getName()[5:]) for p in found if fs.exists(at(p, "_SUCCESS")))


def add_sources(messages: DataFrame, path: str) -> int:
    """Indexes the sources of ``messages``, which must be whole; what the index had of them before no longer counts. Returns the number of the new part."""
    spark = messages.sparkSession
    parts = _parts(spark, path)
    part = parts[-1] + 1 if parts else 0
    to = lambda table: f"{path}/{table}/part={part}"
    # positions are found once, and all tables come from them
    pos = (F.row_number().over(W.partitionBy("source_path").orderBy("msg_index")) - 1).cast("int")
    rows = messages.select("source_path", "msg_index", "chat_name", "type", pos.alias("pos"), tokenize(_lines()).alias("tokens"))
    heads = messages.select("source_path", "chat_name").distinct().select("source_path", "chat_name", F.lower(_head()).alias("head"))
    heads.write.mode("overwrite").parquet(to("heads"))
    count = lambda tokens: F.explode(F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("term"), F.size(F.filter(tokens, lambda x: x == t)).alias("n"))))
    of_rows = rows.select("source_path", F.lit("").alias("of_chat"), "pos", count(F.col("tokens")).alias("p"))
    of_heads = spark.read.schema(SCHEMAS["heads"]).parquet(to("heads")).select("source_path", F.coalesce("chat_name", F.lit("")).alias("of_chat"), F.lit(-1).alias("pos"), count(tokenize(F.col("head"))).alias("p"))
    postings = of_rows.unionByName(of_heads).select(_bucket(F.col("p.term")).alias("bucket"), F.col("p.term").alias("term"), "source_path", "of_chat", "pos", F.col("p.n").alias("n"))
    # a very frequent term is dealt to many files by its sources
    dealt = postings.repartition(F.col("bucket"), F.pmod(F.xxhash64("source_path"), F.lit(8))).sortWithinPartitions("bucket", "term", "source_path")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(to("postings"))
    spark.read.schema(SCHEMAS["postings"]).parquet(to("postings")).select("term").distinct().write.mode("overwrite").parquet(to("vocabulary"))
    rows.select("source_path", "pos", "msg_index", "chat_name", "type").write.mode("overwrite").parquet(to("places"))
    return part


class Index:
    """The tables of the parts that are whole, of each source's last part alone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.parts = spark, path, _parts(spark, path)
        if not self.parts:
            raise ValueError(f"no index at {path}")
        if len(self.parts) > 1:
            self.current = self._read("heads").groupBy(F.col("source_path").alias("__source")).agg(F.max("part").alias("__part"))

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[table]).option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{table}/part={p}" for p in self.parts])

    def table(self, table: str) -> DataFrame:
        rows = self._read(table)
        if len(self.parts) == 1:
            return rows
        return rows.join(self.current, (F.col("source_path") == F.col("__source")) & (F.col("part") == F.col("__part")), "left_semi")

    def postings(self, terms: list[str]) -> DataFrame:
        """Those of a few terms: only their buckets are read."""
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t"))).distinct().collect()]
        return self.table("postings").filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    def postings_like(self, fits: Column) -> DataFrame:
        words = self._read("vocabulary").select("term").filter(fits).distinct()
        return self.table("postings").join(words, "term", "left_semi")


def phrase_runs(phrase: str) -> list[tuple[str, bool, bool]]:
    """The runs of a phrase that terms are made of, and whether each begins and ends the phrase, where it may be a part of a longer word."""
    return [(m[0], m.start() == 0, m.end() == len(phrase)) for m in re.finditer(r"[a-z0-9_]+|[一-鿿]+", phrase)]


def _phrase_places(index: Index, messages: DataFrame, phrase: str) -> DataFrame:
    """``source_path, of_chat, pos``: messages, and heads (-1), with the phrase in one of their lines."""
    heads = index.table("heads").filter(F.contains("head", F.lit(phrase))).select("source_path", F.coalesce("chat_name", F.lit("")).alias("of_chat"), F.lit(-1).alias("pos"))
    runs = [r for r in phrase_runs(phrase) if len(r[0]) > 1 or r[0] > "一"]
    if runs:
        run, first, last = max(runs, key=lambda r: (len(r[0]), not (r[1] or r[2])))
        if run[0] >= "一" or not (first or last):
            found = index.postings([run[:3] if run[0] >= "一" else run])
        else:
            term = F.col("term")
            found = index.postings_like(term.contains(run) if first and last else term.endswith(run) if first else term.startswith(run))
        found = found.filter("pos >= 0").select("source_path", "pos").distinct()
        if run == phrase and (run[0] < "一" or len(run) <= 3):
            return heads.unionByName(found.select("source_path", F.lit("").alias("of_chat"), "pos"))
        where = found.join(index.table("places"), ["source_path", "pos"]).select("source_path", "pos", "msg_index")
        sources = [r[0] for r in where.select("source_path").distinct().limit(NAMED_SOURCES + 1).collect()]
        if len(sources) <= NAMED_SOURCES:
            messages = messages.filter(F.col("source_path").isin(sources))
    else:  # nothing that is indexed: all messages are read
        where = index.table("places").select("source_path", "pos", "msg_index")
    read = messages.join(where, ["source_path", "msg_index"]).filter(F.lower(_lines()).contains(phrase))
    return heads.unionByName(read.select("source_path", F.lit("").alias("of_chat"), "pos"))


def counted_windows(index: Index, messages: DataFrame, question: str, terms: list[str], window: int, chats: list[str] | None = None, type_: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The windows that have a term or the phrase (``source_path, chat_name, center_index, counts, phrase``), and one row with the number of all windows (``n``) and of those with each term."""
    phrase = question.strip().lower()
    centres = index.table("places").filter(in_chats(chats, "chat_name", "source_path"))
    if type_ is not None:
        centres = centres.filter(F.col("type") == type_)
    total = centres.agg(F.count("*").alias("n"))
    none = index.spark.createDataFrame([], "source_path string, of_chat string, pos int, term string, n int")
    hits = index.postings(terms).select("source_path", "of_chat", "pos", "term", "n") if terms else none
    if phrase:
        hits = hits.unionByName(_phrase_places(index, messages, phrase).select("source_path", "of_chat", "pos", F.lit(None).cast("string").alias("term"), F.lit(1).alias("n")))
    near = hits.filter("pos >= 0").select("source_path", F.explode(F.sequence(F.col("pos") - window, F.col("pos") + window)).alias("pos"), "term", "n")
    whole = hits.filter("pos < 0").select(F.col("source_path").alias("__source"), F.col("of_chat").alias("__chat"), "term", "n")
    in_head = centres.select("source_path", "chat_name", "pos").join(whole, (F.col("source_path") == F.col("__source")) & (F.coalesce("chat_name", F.lit("")) == F.col("__chat"))).select("source_path", "pos", "term", "n")
    sums = [F.sum(F.when(F.col("term") == t, F.col("n")).otherwise(0)).cast("int") for t in terms]
    counts = F.array(*sums) if sums else F.array().cast("array<int>")
    found = near.unionByName(in_head).groupBy("source_path", "pos").agg(counts.alias("counts"), F.bool_or(F.col("term").isNull()).alias("phrase"))
    rows = centres.join(found, ["source_path", "pos"]).select("source_path", "chat_name", F.col("msg_index").alias("center_index"), "counts", "phrase")
    df = rows.agg(*[F.count_if(F.col("counts")[i] > 0).alias(f"df{i}") for i in range(len(terms))]) if terms else index.spark.range(1).select(F.lit(0).alias("__none"))
    return rows, total.join(F.broadcast(df))  # one row each


def ask_index(path: str, messages: DataFrame, question: str, k: int = 5, window: int = 2, chats: list[str] | None = None, type_: str | None = None) -> DataFrame:
    """As :func:`confab.operators.context.ask`, from the index at ``path``, for sources of which all messages or none are of the chosen chats: the terms' postings and the messages' places are read; of ``messages`` only those of the chosen
    windows, and those in which the words of a phrase of several words are to be found side by side."""
    if not 1 <= k <= 50 or window < 0 or not question.strip():
        raise ValueError("a question, 1 to 50 results and a window of 0 or more are needed")
    if "\n" in question.strip():
        raise ValueError("a question of one line is needed")
    spark = messages.sparkSession
    terms = question_terms(spark, question)
    rows, stats = counted_windows(Index(spark, path), messages, question, terms, window, chats, type_)
    best = select_non_overlapping(scored(rows, stats, terms, question.strip().lower()), k, window)
    return with_messages(best, messages, window)
