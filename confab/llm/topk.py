"""Exact top-k search by inner product: dual cover trees, in blocks.

A bounded sample of rows serves as pivots. Every vector belongs to the cell of its nearest pivot, and the k-th best score of a
query among the pivots is a first lower bound. The vectors of a cell are dealt to blocks, and its queries to groups; over each block and each group a
cover tree is built once and stored. A group meets only those cells whose best possible product, from centres and covering radii, reaches the
group's worst bound. Groups are sent to the blocks that they meet, many groups and many blocks to a task, so each vector that is moved is compared
with tens of thousands of others. The task descends a group's tree and a block's together, largest bound first, and prunes pairs of nodes whose bound
is under the worst k-th score of the query node. A last step takes the best k over all blocks.

A cover tree's node of level l has one of its own vectors as centre and covers all its vectors within BASE ** l. Its children are of level l - 1 (chains of
single children are left out: a node has the lowest level that covers it); the first has the same centre, and their centres lie more than BASE ** (l - 1) apart. A node
of few vectors is a leaf, and so is one that would need a child for every few vectors, as happens in high dimensions. Bounds use each node's true radius.

Pruning is strict (a bound equal to the k-th score is followed up), so ties are exact. Of equal vectors in a block only
the k + 1 smallest ids can be among any query's best k, so more are not kept there: a vector with very many copies costs little.

Edge cases: vectors that are null or empty, or hold null or non-finite components, and rows without an id take no part. Vectors of
different lengths are filled up with zeros. Scaled components, and scores, that 64 bits cannot hold become the largest or smallest number that they can. Repeated rows are told
apart by their place: each is a candidate for the others. Fewer than k candidates give fewer ranks; no queries or an empty table give no rows. Other columns take no part,
whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confab.llm.common import kept, scratch, store

#: Rows of a block, queries of a group, vectors of a leaf; most pivots; blocks, and groups, that meet in one task.
BLOCK, GROUP, LEAF, PIVOTS, TOGETHER = 2048, 1024, 64, 512, 32
#: The ratio of covering radii from level to level.
BASE = 1.3


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component; null for vectors that take no part."""
    fine = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when((F.size(vector) > 0) & fine, F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long")))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of two int64 matrices: in double precision where that is exact, else in whole numbers of any size; what
    64 bits can't hold becomes the largest or smallest number that they can."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class CoverTree:
    """A cover tree over the rows of a matrix, as arrays by node, in which children and rows of a node lie side by side."""

    ARRAYS = {"order": np.int64, "centre": np.int64, "level": np.int64, "radius": np.float64, "first": np.int64, "last": np.int64, "child": np.int64, "children": np.int64}

    def __init__(self, x: np.ndarray):
        """``order``: rows, so that node i has ``order[first[i]:last[i]]``; ``centre``: a row; ``child``: the number of the first child."""
        nodes, order, queue = [], np.empty(len(x), np.int64), [(0, np.arange(len(x)))]
        for at, (first, rows) in enumerate(queue):
            part = x[rows]
            near = np.sqrt(((part - part[0]) ** 2).sum(axis=1))  # the first row is the centre
            radius = float(near.max())
            level = int(np.ceil(np.log(radius) / np.log(BASE) - 1e-12)) if radius > 0 else -(10**6)
            order[first : first + len(rows)] = rows
            node = [rows[0], level, radius, first, first + len(rows), len(queue), 0]
            nodes.append(node)
            if len(rows) <= LEAF or radius == 0:
                continue
            nearest, centres, limit = np.zeros(len(rows), np.int64), [0], BASE ** (level - 1)
            while near.max() > limit and len(centres) <= max(16, len(rows) // 4):
                far = int(near.argmax())
                d = np.sqrt(((part - part[far]) ** 2).sum(axis=1))
                closer = d < near
                near[closer], nearest[closer] = d[closer], len(centres)
                centres.append(far)
            if near.max() > limit:
                continue  # a leaf
            for c, centre in enumerate(centres):
                own = np.flatnonzero(nearest == c)
                own = np.concatenate([[centre], own[own != centre]])
                queue.append((first, rows[own]))
                first += len(own)
            node[6] = len(centres)
        self.order = order
        for name, values in zip(list(self.ARRAYS)[1:], zip(*nodes, strict=True), strict=True):
            setattr(self, name, np.array(values, self.ARRAYS[name]))

    def packed(self) -> list[bytes]:
        return [getattr(self, n).tobytes() for n in self.ARRAYS]

    @classmethod
    def of(cls, x: np.ndarray, blobs: list[bytes]) -> CoverTree:
        """The stored tree over ``x``, the rows in the tree's order."""
        tree = cls.__new__(cls)
        for (name, kind), blob in zip(cls.ARRAYS.items(), blobs, strict=True):
            setattr(tree, name, np.frombuffer(blob, kind))
        tree.x, tree.points = x, x.astype(np.float64)
        place = np.empty(len(tree.order), np.int64)
        place[tree.order] = np.arange(len(tree.order))
        tree.at = tree.points[place[tree.centre]]
        tree.norm = np.sqrt((tree.at**2).sum(axis=1))
        return tree


def bounds(q: CoverTree, a: np.ndarray, x: CoverTree, b: np.ndarray) -> np.ndarray:
    """No inner product between the rows of nodes ``a`` and those of nodes ``b`` is larger."""
    top = q.at[a] @ x.at[b].T + np.outer(q.radius[a], x.norm[b]) + np.outer(q.norm[a], x.radius[b]) + np.outer(q.radius[a], x.radius[b])
    return at_most(top)


def at_most(top: np.ndarray) -> np.ndarray:
    """A bound with room for rounding, within the range of scores."""
    return np.clip(top + 1e-9 * np.abs(top) + 1e-6, -(2.0**63), 2.0**63)


def dual_search(q: CoverTree, q_row: np.ndarray, worst: np.ndarray, best: list[list], x: CoverTree, x_row: np.ndarray, x_id: np.ndarray, k: int) -> None:
    """Puts what ``x`` has into each query's ``best`` k of (score, -id, -row), a heap, among scores of at least ``worst``, which rises; a row never finds itself."""
    tick = count()
    root = np.zeros(1, np.int64)
    heap = [(-float(bounds(q, root, x, root)[0, 0]), next(tick), 0, 0)]
    while heap:
        top, _, a, b = heapq.heappop(heap)
        asks, has = slice(q.first[a], q.last[a]), slice(x.first[b], x.last[b])
        if -top < worst[asks].min():
            continue
        if q.children[a] or x.children[b]:
            down_q = q.children[a] and (q.radius[a] >= x.radius[b] or not x.children[b])
            of_q = np.arange(q.child[a], q.child[a] + q.children[a]) if down_q else np.array([a])
            of_x = np.array([b]) if down_q else np.arange(x.child[b], x.child[b] + x.children[b])
            top = bounds(q, of_q, x, of_x)
            low = np.array([worst[q.first[c] : q.last[c]].min() for c in of_q])
            for i, j in zip(*np.nonzero(top >= low[:, None]), strict=True):
                heapq.heappush(heap, (-float(top[i, j]), next(tick), int(of_q[i]), int(of_x[j])))
            continue
        scores = products(q.x[asks], x.x[has])
        for i in np.flatnonzero(scores.max(axis=1) >= worst[asks]):
            r = int(asks.start + i)
            for j in np.flatnonzero(scores[i] >= worst[r]):
                c = int(has.start + j)
                if x_row[c] != q_row[r]:
                    item = (int(scores[i, j]), -int(x_id[c]), -int(x_row[c]))
                    if len(best[r]) < k:
                        heapq.heappush(best[r], item)
                    else:
                        heapq.heappushpop(best[r], item)
            if len(best[r]) == k:
                worst[r] = max(worst[r], best[r][0][0])


def _matrix(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.int64).reshape(len(blobs), -1)


_TREE = "grp int, cell int, n int, low binary, id binary, rid binary, x binary, tree array<binary>"


def _tree(part: pd.DataFrame) -> pd.DataFrame:
    """One row for the rows of a block or group: its tree, and all columns in the tree's order."""
    x = _matrix(part.x.tolist())
    tree = CoverTree(x.astype(np.float64))
    o = tree.order
    blob = lambda c, kind: part[c].to_numpy(kind)[o].tobytes()
    return pd.DataFrame([(part.grp.iloc[0], part.cell.iloc[0], len(x), blob("low", np.float64), blob("id", np.int64), blob("rid", np.int64), x[o].tobytes(), tree.packed())], columns=[c.split()[0] for c in _TREE.split(", ")])


def _opened(row) -> tuple[CoverTree, np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(row.x, np.int64).reshape(row.n, -1)
    return CoverTree.of(x, list(row.tree)), *(np.frombuffer(b, kind) for b, kind in ((row.low, np.float64), (row.id, np.int64), (row.rid, np.int64)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query`` holds, its best k other rows, ties to the smaller id."""
    with scratch(vectors.sparkSession):
        return kept(_top_k(vectors, is_query, k, vec_id, vector), "top_k")


def _top_k(vectors: DataFrame, is_query: Column, k: int, vec_id: str, vector: str) -> DataFrame:
    # the vectors are stored with their numbers at once, so these need not be found again
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), scaled(F.col(vector)).alias("x"), F.coalesce(is_query, F.lit(False)).alias("is_query")).withColumn("rid", F.monotonically_increasing_id())
    rows = store(rows.filter("x is not null and id is not null"), "vectors")
    n, dim = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    dim = dim or 1
    fill = lambda v: np.pad(np.asarray(v, np.int64), (0, dim - len(v)))
    chosen = rows.orderBy(F.xxhash64("id", "rid"), "rid").limit(max(16, min(PIVOTS, n // BLOCK))).collect()
    pivot, pivot_row = np.array([fill(r.x) for r in chosen], np.int64).reshape(-1, dim), np.array([r.rid for r in chosen], np.int64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pf = pivot.astype(np.float64)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x = np.array([fill(v) for v in batch.column(1).to_pylist()], np.int64)
                xf, rid, query = x.astype(np.float64), batch.column(3).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
                cell = ((pf**2).sum(axis=1) - 2 * xf @ pf.T).argmin(axis=1)
                radius = np.sqrt(((xf - pf[cell]) ** 2).sum(axis=1))
                low = np.full(len(x), -np.inf)
                if query.any():
                    own = np.where(pivot_row[None, :] == rid[query][:, None], -np.inf, products(x[query], pivot).astype(np.float64))
                    if own.shape[1] > k:
                        low[query] = np.sort(own, axis=1)[:, -k]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(rid), batch.column(2), pa.array(cell.astype(np.int32)), pa.array(radius), pa.array(low), pa.array([v.tobytes() for v in x], pa.binary())],
                    names=["id", "rid", "is_query", "cell", "radius", "low", "x"],
                )

    kinds = "id long, rid long, is_query boolean, cell int, radius double, low double, x binary"
    cells = store(rows.select("id", "x", "is_query", "rid").mapInArrow(placed, kinds), "cells")
    # one row for each pivot at most
    stats = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("r"), F.count_if("is_query").alias("q")).orderBy("cell").collect()
    table, block, group = [], 0, 0
    for s in stats:
        table.append((s.cell, block, blocks := -(-s.n // BLOCK), group, groups := -(-s.q // GROUP)))
        block, group = block + blocks, group + groups
    spark = vectors.sparkSession
    deal = spark.createDataFrame(table, "cell int, block0 int, blocks int, group0 int, groups int")
    dealt = lambda first, n: (F.col(first) + F.pmod(F.xxhash64("rid"), F.greatest(F.col(n), F.lit(1))).cast("int")).alias("grp")
    columns = ["cell", "id", "rid", "low", "x"]
    with_deal = cells.join(F.broadcast(deal), "cell")

    def block_tree(part: pd.DataFrame) -> pd.DataFrame:
        return _tree(part.sort_values(["id", "rid"]).groupby("x", sort=False).head(k + 1))

    trees = store(with_deal.select(dealt("block0", "blocks"), *columns).groupBy("grp").applyInPandas(block_tree, _TREE), "trees")
    asks = store(with_deal.filter("is_query").select(dealt("group0", "groups"), *columns).groupBy("grp").applyInPandas(_tree, _TREE), "asks")
    cell_of, radius_of = np.array([s.cell for s in stats], np.int64), np.array([s.r for s in stats])
    first_block, many = np.array([t[1] for t in table], np.int64), np.array([t[2] for t in table], np.int64)

    def meets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = pivot[cell_of].astype(np.float64)
        norms = np.sqrt((centres**2).sum(axis=1))
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                tree, low, _, _ = _opened(row)
                top = centres @ tree.at[0] + radius_of * tree.norm[0] + tree.radius[0] * (norms + radius_of)
                near = np.flatnonzero(at_most(top) >= low.min())
                halls = np.unique(np.concatenate([np.arange(first_block[c], first_block[c] + many[c]) // TOGETHER for c in near] or [np.zeros(0, np.int64)]))
                out += [(h, row.grp // TOGETHER, row.grp) for h in halls]
            yield pd.DataFrame(out, columns=["hall", "party", "grp"])

    met = store(asks.mapInPandas(meets, "hall int, party int, grp int"), "met")
    pairs = met.select(F.col("hall").alias("in_hall"), F.col("party").alias("of_party")).distinct()
    here = trees.withColumn("hall", F.floor(F.col("grp") / TOGETHER).cast("int")).join(pairs, F.col("hall") == F.col("in_hall")).select(*trees.columns, "hall", F.col("of_party").alias("party"))
    there = asks.join(met, "grp").select(*asks.columns, "hall", "party")

    def search(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        halls = [_opened(r) for r in found.sort_values("grp").itertuples(index=False)]
        for ask in asked.sort_values("grp").itertuples(index=False):
            q, low, q_id, q_row = _opened(ask)
            worst, best, root = low.copy(), [[] for _ in q_id], np.zeros(1, np.int64)
            tops = [float(bounds(q, root, x, root)[0, 0]) for x, *_ in halls]
            for i in np.argsort(-np.array(tops), kind="stable"):  # the most promising block first
                x, _, x_id, x_row = halls[i]
                if tops[i] >= worst.min():
                    dual_search(q, q_row, worst, best, x, x_row, x_id, k)
            for i, items in enumerate(best):
                out += [(q_id[i], q_row[i], -b, -row, s) for s, b, row in items]
        return pd.DataFrame(out, columns=["query_id", "query_row", "vec_id", "vec_row", "score"])

    keys = ["hall", "party"]
    renamed = here.select(*[F.col(c).alias(c) for c in here.columns])
    hits = there.groupBy(*keys).cogroup(renamed.groupBy(*keys)).applyInPandas(search, "query_id long, query_row long, vec_id long, vec_row long, score long")
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
