"""Helpers that the operators of this package share: tables in the shared folder, row numbers, words as numbers."""

from __future__ import annotations

import atexit
import gc
import hashlib
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define it.
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. It is the cluster's ``spark.checkpoint.dir``; only where that is
    unset (tests on one machine) a temporary folder takes its place."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-confab-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base


class _Open(threading.local):
    """The tables written within each ``scratch()`` that this thread has open."""

    def __init__(self):
        self.paths: list[list[str]] = []


_open = _Open()


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: this cuts the lineage, so later jobs start
    from files that outlive any executor. Within ``scratch()`` the files go when that ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/confab-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    if _open.paths:
        _open.paths[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def store_bucketed(df: DataFrame, by: str, files: int) -> DataFrame:
    """``df`` written to a bucketed table in the shared folder: later groupings by ``by`` need no shuffle of it."""
    spark, name = df.sparkSession, f"confab_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}/data"
    df.write.bucketBy(files, by).option("path", path).option("compression", "zstd").option("parquet.block.size.row.check.min", "1").saveAsTable(name)
    if _open.paths:
        _open.paths[-1].append(path)
    out = spark.table(name)
    out.stored_at = path
    return out


def discard(*stored: DataFrame) -> None:
    """Deletes stored tables that nothing needs any more."""
    for df in stored:
        delete(df.sparkSession, [df.stored_at])
        for paths in _open.paths:
            if df.stored_at in paths:
                paths.remove(df.stored_at)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes stored tables, with the folders that hold them alone."""
    for p in paths:
        if p.endswith("/data"):  # a bucketed table; this leaves its files
            spark.sql(f"DROP TABLE IF EXISTS {p.split('/')[-2]}")
        parent = spark._jvm.org.apache.hadoop.fs.Path(p).getParent()
        parent.getFileSystem(spark._jsc.hadoopConfiguration()).delete(parent, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end, but for those that ``kept`` hands on."""
    _open.paths.append([])
    try:
        yield
    finally:
        delete(spark, _open.paths.pop())


def kept(df: DataFrame, name: str) -> DataFrame:
    """``store`` for a result that outlives the innermost ``scratch()``."""
    out = store(df, name)
    if _open.paths:
        path = _open.paths[-1].pop()
        for outer in _open.paths[-2:-1]:
            outer.append(path)
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps, which it does only when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


#: Up to so many input files have their numbers broadcast (some hundred bytes each).
NUMBERED_FILES = 20_000


def _rows_of_files(df: DataFrame) -> bool:
    """Whether each row of ``df`` is one row of a file: nothing but selections and filters stands over one scan. Generators, joins, unions and samples make others."""
    plan = df._jdf.queryExecution().analyzed()
    while (name := plan.getClass().getSimpleName()) in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return name == "LogicalRelation"


def with_row_id(docs: DataFrame, name: str = "rid") -> DataFrame:
    """A unique number for each row, the same in every job whatever the number of cores then: the number of the row's
    file and its place in that file. Rows that are not those of files as they are (made by ``explode``, a join, a union), or come from very many files, get numbers once and are stored."""
    spark = docs.sparkSession
    stored = lambda: store(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    if not _rows_of_files(docs):
        return stored()
    try:
        files = docs.select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    except AnalysisException:
        return stored()
    paths = [r[0] for r in files.select("__file").distinct().limit(NUMBERED_FILES + 1).collect()]
    if len(paths) > NUMBERED_FILES:
        return stored()
    if len(paths) <= 1:
        return docs.withColumn(name, F.col("_metadata.row_index"))
    numbers = spark.createDataFrame(list(enumerate(sorted(paths))), "__number long, __path string")
    numbered = docs.withColumns({"__path": F.col("_metadata.file_path"), "__index": F.col("_metadata.row_index")})
    # at most NUMBERED_FILES rows
    return numbered.join(F.broadcast(numbers), "__path").withColumn(name, F.shiftleft("__number", 40) + F.col("__index")).drop("__path", "__number", "__index")


def held_out(doc_id: str, remainder: int):
    """True where crc32 of the id, as text, leaves ``remainder`` modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == remainder


#: Up to so many row numbers (8 bytes each) are broadcast; beyond it the rows are joined by a shuffle.
BROADCAST_ROWS = 500_000


def pick_rows(rows: DataFrame, ids: DataFrame, how: str, on: str = "rid") -> DataFrame:
    """``rows`` whose ``on`` is (``how="left_semi"``) or isn't (``"left_anti"``) among ``ids``: without a shuffle of the rows if the ids are few."""
    ids = store(ids.distinct(), "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, on, how)


def texts_of(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    """The UTF-8 bytes of each row's text; null counts as empty."""
    for x in batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()):
        yield x.as_py() or b""


def by_size(batch: pa.RecordBatch, column: str, most: int = 2 << 20, rows: int = 10_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch, with the texts, of about ``most`` bytes and at most ``rows`` rows."""
    texts, at, size = [], 0, 0
    for i, x in enumerate(texts_of(batch, column)):
        texts.append(x)
        size += len(x)
        if size > most or len(texts) == rows:
            yield batch.slice(at, i + 1 - at), texts
            texts, at, size = [], i + 1, 0
    if texts:
        yield batch.slice(at), texts


# --- words as numbers ------------------------------------------------------------------------------------------------

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (a multiply-and-shift finaliser)."""
    x = x ^ (x >> _SHIFT)
    x = x * _M1
    x = x ^ (x >> _SHIFT)
    x = x * _M2
    return x ^ (x >> _SHIFT)


#: Bytes that are hashed at a time.
_PIECE = 1 << 18
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
#: A 64-bit number for each byte, the same for A-Z and a-z; the odd base of the polynomial, and its inverse modulo 2**64.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E6C63D0876A9A47


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    of = lambda x: np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n - 1, x, np.uint64))])
    return of(_BASE), of(pow(_BASE, -1, 1 << 64))


def _hashed(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit numbers of the lower-cased words in bytes that end with white space, and where they start."""
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    if len(raw) <= _PIECE + 1:
        power, inverse = _powers(_PIECE + 1)
    else:  # a long word
        power, inverse = (np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(len(raw) - 1, x, np.uint64))]) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    sums = np.cumsum(_BYTE[raw] * power[: len(raw)], dtype=np.uint64)
    before = np.where(start > 0, sums[start - 1], np.uint64(0))
    return mix((sums[end - 1] - before) * inverse[start] + mix((end - start).astype(np.uint64))), start


def word_numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit numbers of all lower-cased words of ``texts`` (a polynomial over their bytes), one after the other, and how many each text has."""
    words, counts, held, size = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64), [], 0

    def flush() -> None:
        if held:
            numbers, start = _hashed(np.frombuffer(b" ".join(x for _, x in held) + b" ", np.uint8))
            ends = np.cumsum([len(x) + 1 for _, x in held])
            np.add.at(counts, np.array([i for i, _ in held]), np.bincount(np.searchsorted(ends, start, side="right"), minlength=len(held)))
            words.append(numbers)
            held.clear()

    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            piece = text[at : at + _PIECE]
            if at + _PIECE < len(text):  # cut between words
                cut = max(piece.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                if cut < 0:
                    ends = [e for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (e := text.find(c, at + _PIECE)) >= 0]
                    cut = min(ends, default=len(text)) - at
                piece = text[at : at + cut + 1]
            if size + len(piece) > _PIECE:
                flush()
                size = 0
            held.append((i, piece))
            size += len(piece) + 1
            at += len(piece)
    flush()
    return np.concatenate(words), counts


def digest(x: np.ndarray) -> bytes:
    """A 128-bit cryptographic name of an array."""
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def drop_rows(rows: DataFrame, dropped: DataFrame, row: str) -> DataFrame:
    """``rows`` without those whose number ``row`` is in ``dropped.rid``, and without the column of numbers."""
    return pick_rows(rows, dropped.select(F.col("rid").alias(row)), "left_anti", row).drop(row)
