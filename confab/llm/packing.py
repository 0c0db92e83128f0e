"""Concatenate and cut: all documents' tokens, one after the other, cut into windows of a fixed length.

First pass: each task encodes its partition, counts tokens up to each document and writes them, two bytes an id where
the vocabulary allows. The totals of the partitions, one small row each, are summed up in order, which gives every document its
global place. Second pass: each document is cut where windows end; a document that crosses a border gives a piece
on each side. The tokens are never shuffled, and only the last window is not full.

Edge cases: a null or empty text has its end token alone; a very long one is encoded whole and cut into as many pieces as it needs. Fully repeated rows are packed once
each, in the order of their partitions, and there are no ties. An empty table gives no pieces. Other columns, of whatever names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confab.llm.bpe import vocabulary
from confab.llm.common import store, texts_of


def tokenised(docs: DataFrame, path: str, end_id: int, text: str, doc_id: str) -> DataFrame:
    """``(part, before, doc_id, n, ids)``: each document's ids with its end token, its partition, and the tokens before it there."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, part, before = vocabulary(path), TaskContext.get().partitionId(), 0
        narrow = "<u2" if len(vocab.offsets) - 1 <= 1 << 16 else "<u4"
        end = np.array([end_id], narrow).tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                ids = [np.frombuffer(vocab.encode(x), "<u4").astype(narrow).tobytes() + end for x in texts_of(batch, text)]
                n = np.array([len(x) for x in ids]) // np.dtype(narrow).itemsize
                ends = before + np.cumsum(n)
                before = int(ends[-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), part, np.int32)), pa.array(ends - n, pa.int64()), batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    names=["part", "before", "doc_id", "n", "ids"],
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias(text))
    return rows.mapInArrow(run, f"part int, before long, doc_id {kind}, n long, ids binary")


def pack(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` (little-endian 32-bit numbers)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    tokens = store(tokenised(docs, path, end_id, text, doc_id), "tokens")
    totals = tokens.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    first = totals.select("part", F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    # one row for each input partition: of a size that is known before the job runs
    placed = tokens.join(F.broadcast(first), "part").select("doc_id", "n", "ids", (F.col("first") + F.col("before")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n, begin = part.column(1).to_numpy(zero_copy_only=False), part.column(3).to_numpy(zero_copy_only=False)
                pieces = (begin + n - 1) // length - begin // length + 1
                row = np.repeat(np.arange(len(n)), pieces)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                window = begin[row] // length + nth
                start = np.maximum(window * length - begin[row], 0)
                stop = np.minimum((window + 1) * length - begin[row], n[row])
                blobs = []
                for k, x in enumerate(part.column(2).to_pylist()):
                    wide = np.frombuffer(x, "<u2" if len(x) == 2 * n[k] else "<u4").astype("<u4")
                    blobs.append(wide)
                ids = [blobs[r][a:b].tobytes() for r, a, b in zip(row, start, stop, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(start), pa.array(stop - start), pa.array(n[row]), pa.array(window), pa.array((begin[row] + start) % length), pa.array(ids, pa.binary())],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    return placed.mapInArrow(cut, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
