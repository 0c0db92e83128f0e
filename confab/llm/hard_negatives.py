"""Hard negatives: for each anchor and each of its positives, the best rows of other labels whose score lies in a window under the positive's.

An anchor's positives are its best rows of the same label. Each has a window of scores, from ``low`` to ``high`` percent of its own. The best rows under an upper limit,
less those under the lower one, are the best rows of the window; so the upper limits of an anchor's positives, in descending order, split the scores into
disjoint slots, and it is enough to know the best few rows of each slot. Tasks compare a chunk of anchors with a chunk of rows and keep the best few of each slot
(the combiner); a shuffle by (anchor, slot) merges these, and a descending merge over an anchor's slots, from the last one up, gives the best rows under each limit. All overlapping
windows are thus answered from one pass, in which each score is looked at once.

Vectors are packed into chunks of CHUNK bytes, and chunks of rows and of anchors meet in tasks: all anchors against all rows, in blocks of matrix products. Of equal vectors of one label in a chunk only the few with the
smallest ids can be among the best of any slot; the rest aren't compared. What leaves a task are at most ``k`` rows for each anchor and slot.

Edge cases: rows whose label, id or vector is null, whose vector is empty or holds a null or non-finite component take no part. Vectors of different lengths are filled up with zeros. Scaled components, and
scores, that 64 bits can't hold become the largest or smallest number that they can. Repeated rows are told apart by their place: each is a row of its own for the others, and an anchor of its own. Of equal scores the smaller id comes first. Fewer rows than asked for
give fewer ranks; anchors without a positive, or windows without a row, give none, as do negative scores of positives, whose windows are empty. An empty table gives no rows. Other columns take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confab.llm.common import kept, scratch, store
from confab.llm.topk import products, scaled

#: Bytes of a chunk of vectors (as 64-bit numbers), chunks of rows that meet an anchor chunk in one task, chunks of anchors in a task, and anchors that are compared at a time.
CHUNK, ROWS_TOGETHER, ANCHORS_TOGETHER, AT_A_TIME = 1 << 20, 16, 4, 64
_PACKED = "chunk int, n int, id binary, rid binary, label binary, x binary"


def _pack(rows: DataFrame, per_chunk: int, dim: int, limits: bool = False) -> DataFrame:
    """``rows`` in chunks of about ``per_chunk``, one row a chunk, by label and id within it; with ``limits``, their arrays too."""
    chunks = max(1, -(-rows.count() // per_chunk))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["label", "id", "rid"])
        x = np.zeros((len(part), dim), np.int64)
        for i, v in enumerate(part["x"]):
            x[i, : len(v)] = v
        blobs = [part[c].to_numpy(np.int64).tobytes() for c in ("id", "rid", "label")]
        more = [part["limits"].tolist()] if limits else []
        return pd.DataFrame([(part["chunk"].iloc[0], len(part), *blobs, x.tobytes(), *more)], columns=["chunk", "n", "id", "rid", "label", "x", *(["limits"] if limits else [])])

    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("rid"), F.lit(chunks)).cast("int"))
    return store(dealt.groupBy("chunk").applyInPandas(pack, _PACKED + (", limits array<array<bigint>>" if limits else "")), "chunks")


class _Chunk:
    def __init__(self, row):
        self.id, self.rid, self.label = (np.frombuffer(b, np.int64) for b in (row.id, row.rid, row.label))
        self.x = np.frombuffer(row.x, np.int64).reshape(row.n, -1)

    def fewer_copies(self, most: int) -> _Chunk:
        """Without all but the first ``most`` of equal vectors of one label."""
        out = object.__new__(_Chunk)
        _, same = np.unique(np.column_stack([self.label, self.x]).view(f"V{8 * (self.x.shape[1] + 1)}").ravel(), return_inverse=True)
        order = np.argsort(same, kind="stable")  # rows stand by label and id already
        first = np.r_[True, same[order][1:] != same[order][:-1]]
        nth = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        keep = np.sort(order[nth < most])
        out.id, out.rid, out.label, out.x = self.id[keep], self.rid[keep], self.label[keep], self.x[keep]
        return out


def _best(scores: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` of the places ``at`` with the highest scores, ties to the smaller id."""
    if len(at) > k:
        s = scores[at]
        at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return at[np.lexsort((ids[at], ~scores[at]))[:k]]


def _compare(anchors: DataFrame, rows: DataFrame, pick, kinds: str, most: int) -> DataFrame:
    """``pick(anchor chunk, limits, row chunk)`` over all pairs of chunks; it yields tuples of ``kinds``. ``most``: equal vectors that matter."""
    n_rows, n_anchors = rows.count(), anchors.count()
    halls, parties = (max(1, -(-n // per)) for n, per in ((n_rows, ROWS_TOGETHER), (n_anchors, ANCHORS_TOGETHER)))
    many = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    here = rows.withColumns({"hall": (F.col("chunk") % halls).cast("int"), "party": many(parties)})
    there = anchors.withColumns({"party": (F.col("chunk") % parties).cast("int"), "hall": many(halls)})

    def run(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        asks = [(_Chunk(r), getattr(r, "limits", None)) for r in asked.itertuples(index=False)]
        for r in found.itertuples(index=False):
            chunk = _Chunk(r).fewer_copies(most)
            for ask, limits in asks:
                out += pick(ask, limits, chunk)
        return pd.DataFrame(out, columns=[c.split()[0] for c in kinds.split(", ")])

    keys = ["hall", "party"]
    return there.groupBy(*keys).cogroup(here.select(*[F.col(c).alias(c) for c in here.columns]).groupBy(*keys)).applyInPandas(run, kinds)


def _positives(anchors: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``rid, anchor_id, positive_id, score, nth``: each anchor's best ``k`` other rows of its label."""

    def pick(ask: _Chunk, _, chunk: _Chunk) -> Iterator[tuple]:
        for label in np.intersect1d(ask.label, chunk.label):  # both stand by label
            a0, a1, b0, b1 = (np.searchsorted(x, label, side) for x in (ask.label, chunk.label) for side in ("left", "right"))
            ids, rids = chunk.id[b0:b1], chunk.rid[b0:b1]
            for at in range(a0, a1, AT_A_TIME):
                some = slice(at, min(at + AT_A_TIME, a1))
                for i, scores in enumerate(products(ask.x[some], chunk.x[b0:b1]), at):
                    for j in _best(scores, ids, np.flatnonzero(rids != ask.rid[i]), k):
                        yield ask.rid[i], ask.id[i], ids[j], rids[j], scores[j]

    found = _compare(anchors, rows, pick, "rid long, anchor_id long, positive_id long, positive_rid long, score long", k + 1)
    nth = F.row_number().over(W.partitionBy("rid").orderBy(F.desc("score"), "positive_id", "positive_rid"))
    return found.withColumn("nth", nth).filter(F.col("nth") <= k).drop("positive_rid")


def _slots(anchors: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``rid, slot, best``: the best ``k`` rows of other labels in each slot of an anchor. Its ``limits`` are the upper limits of its slots, in descending order, and then the least score that any window has."""

    def pick(ask: _Chunk, limits, chunk: _Chunk) -> Iterator[tuple]:
        for at in range(0, len(ask.id), AT_A_TIME):
            for i, scores in enumerate(products(ask.x[at : at + AT_A_TIME], chunk.x), at):
                *tops, least = (int(v) for v in limits[i])
                fits = np.flatnonzero((scores <= tops[0]) & (scores >= least) & (chunk.label != ask.label[i]))
                if not len(fits):
                    continue
                # the last limit that a score does not pass
                slot = np.searchsorted(~np.array(tops), ~scores[fits], side="right") - 1
                for s in np.unique(slot):
                    for j in _best(scores, chunk.id, fits[slot == s], k):
                        yield ask.rid[i], int(s), chunk.id[j], chunk.rid[j], scores[j]

    found = _compare(anchors, rows, pick, "rid long, slot int, negative_id long, negative_rid long, score long", k)
    nth = F.row_number().over(W.partitionBy("rid", "slot").orderBy(F.desc("score"), "negative_id", "negative_rid"))
    best = found.withColumn("nth", nth).filter(F.col("nth") <= k)
    item = F.struct(F.bitwise_not("score").alias("o"), "negative_id", "score")  # sorts by descending score
    return best.groupBy("rid", "slot").agg(F.sort_array(F.collect_list(item)).alias("best"))


def mine(vectors: DataFrame, is_anchor: Column, label: Column | str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each row where ``is_anchor`` holds and each of its best ``positives`` rows of the same label, the best ``negatives``
    rows of other labels with ``low * positive_score <= 100 * negative_score <= high * positive_score``."""
    with scratch(vectors.sparkSession):
        return kept(_mine(vectors, is_anchor, F.col(label) if isinstance(label, str) else label, positives, negatives, low, high, vec_id, vector), "hard_negatives")


def _mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int, negatives: int, low: int, high: int, vec_id: str, vector: str) -> DataFrame:
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), scaled(F.col(vector)).alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    rows = store(rows.withColumn("rid", F.monotonically_increasing_id()).filter("x is not null and id is not null and label is not null"), "vectors")
    dim = rows.agg(F.max(F.size("x"))).first()[0] or 1
    per_chunk = max(16, CHUNK // (8 * dim))
    chunks = _pack(rows.drop("is_anchor"), per_chunk, dim)
    anchors = rows.filter("is_anchor").drop("is_anchor")
    found = store(_positives(_pack(anchors, per_chunk, dim), chunks, positives), "positives")
    # whole numbers around low and high percent of a score, within 64 bits
    score = F.col("score").cast("decimal(30,0)")
    upper, lower = F.floor(score * high / 100).cast("long"), F.ceil(score * low / 100).cast("long")
    found = found.withColumns({"upper": upper, "lower": lower}).filter("lower <= upper")
    limits = found.groupBy("rid").agg(F.sort_array(F.collect_set("upper"), False).alias("uppers"), F.min("lower").alias("least"))
    asked = anchors.join(limits, "rid").withColumn("limits", F.concat("uppers", F.array("least")))
    best = store(_slots(_pack(asked.drop("uppers", "least"), per_chunk, dim, limits=True), chunks, negatives), "slots")
    # the last slot first: what is best under a limit is the best of its slot and of all under it
    by_slot = best.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("slot", "best"))).alias("by_slot")).join(limits, "rid")
    kind = "array<struct<o:bigint,negative_id:bigint,score:bigint>>"
    none = F.array().cast(kind)
    down = F.reverse(F.sequence(F.lit(0), F.size("uppers") - 1))
    start = F.struct(none.alias("top"), F.array().cast(f"array<{kind}>").alias("tops"))

    def merge(so_far: Column, slot: Column) -> Column:
        top = F.slice(F.sort_array(F.concat(so_far["top"], F.coalesce(F.try_element_at("by_slot", slot), none))), 1, negatives)
        return F.struct(top.alias("top"), F.concat(F.array(top), so_far["tops"]).alias("tops"))

    tops = by_slot.select("rid", "uppers", F.aggregate(down, start, merge, lambda a: a["tops"]).alias("tops"))
    own = F.element_at("tops", F.array_position("uppers", F.col("upper")).cast("int"))
    hits = found.join(tops, "rid").withColumn("hits", F.filter(own, lambda h: h["score"] >= F.col("lower")))
    return hits.select("anchor_id", "positive_id", F.posexplode("hits").alias("pos", "h"), F.col("score").alias("positive_score")).select(
        "anchor_id", "positive_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("h.negative_id").alias("negative_id"), "positive_score", F.col("h.score").alias("negative_score")
    )
