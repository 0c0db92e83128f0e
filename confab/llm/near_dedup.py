"""Near-duplicate documents by a chosen-path set similarity join.

A document's set are its distinct five-word shingles. Each set is sketched by minwise hashes. Several independent trees
branch the documents: a document goes to the child named by one of its minwise tokens, and documents meet in a child
when they choose the same token. Small nodes are compared exhaustively on their sketches. In large ones, first every document is compared
with leaders: nodes are dealt to chunks, and a chunk's leader is the document that agrees most with its most frequent tokens. What
these comparisons give is confirmed on full sets and joined to components.

Then only those large nodes go on that still hold documents of several components. Where at most SMALL documents are outside of a node's main
component, these are compared with all of it, chunk by chunk; that costs each document no more than a small node does. Other nodes branch,
with two children for each document, and so on; what is left after LEVELS is compared in blocks, exhaustively.
Copies of one text thus leave the trees early, while documents that share no more than a common passage part.

All pairs whose sketches agree enough are confirmed on full sets, best ones first; pairs that are already known to be in one component
need no confirmation. Components are found by spreading the smallest label with pointer jumping. Documents with the same set (the same
number of shingles and the same 128-bit cryptographic digest of them all) are one node of all this, so exact copies cost nothing.

Two documents of similarity 0.75 share a token of the first level with probability 0.75, and one of a node's two children
with 0.94; with two children everywhere a tree misses such a pair with probability below 1/3, at whatever level it ends, and all TREES miss it with
probability below 2e-6. More similar pairs are missed by far less.

Edge cases: a text of fewer than five words is one shingle, its whole sequence of words; a null or empty text, or one of white space
alone, has no shingles, is linked with nothing and is kept. Texts are read whole, however long, in pieces of bounded size. Null ids come after all
others in the choice of a component's smallest id. Of fully repeated rows one is kept; ties do not arise, as components do not depend on order. Other columns
take no part, and may have any names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.llm.common import by_size, digest, drop_rows, kept, mix, pick_rows, scratch, store, with_row_id, word_numbers

WORDS, PERCENT = 5, 75
#: Trees, minwise hashes in a sketch, most levels.
TREES, SKETCH, LEVELS = 12, 64, 8
#: Documents of a node that is compared exhaustively at once; documents outside of a node's main component with which the others are compared.
TINY, SMALL = 64, 512
#: Documents of a large node that are compared with one leader, and most leaders of them.
CHUNK, LEADERS = 2048, 8
#: Shingles of a block that is compared on full sets, about; near ones of a document in a block up to which they are confirmed pair by pair.
BLOCK, FEW = 1_000_000, 8
#: Sketches must agree in so many places for a pair to be confirmed: 0.5, over four deviations below 0.75.
AGREE = SKETCH // 2

_FACTORS = mix(np.arange(1, 2 * WORDS + 1, dtype=np.uint64)) | np.uint64(1)
_SEEDS = mix(np.arange(1001, 1001 + SKETCH, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingles of each text, as 64-bit numbers."""
    words, counts = word_numbers(texts)
    ends = np.cumsum(counts)
    h = words[: max(0, len(words) - WORDS + 1)] * _FACTORS[0]
    for j in range(1, WORDS):
        h = h + words[j : len(words) - WORDS + 1 + j] * _FACTORS[j]
    h, out = mix(h), []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= WORDS:
            out.append(np.unique(h[end - n : end - WORDS + 1]))
        else:
            out.append(mix(np.array([(words[end - n : end] * _FACTORS[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64)) if n else np.zeros(0, np.uint64))
    return out


def sketched(rows: DataFrame) -> DataFrame:
    """``(rid, doc_id, n_shingles, name, sketch)`` of ``(rid, doc_id, text)``; the name tells sets apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in by_size(whole, "text"):
                sets = shingle_sets(texts)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                sketch = np.zeros((len(n), SKETCH), np.uint32)
                if len(full):
                    flat = np.concatenate(sets)
                    starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    for t in range(SKETCH):
                        sketch[full, t] = np.minimum.reduceat(((flat * _SEEDS[t]) >> np.uint64(32)).astype(np.uint32), starts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n), pa.array([digest(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sketch], pa.binary())],
                    names=["rid", "doc_id", "n_shingles", "name", "sketch"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("rid", "doc_id", "text").mapInArrow(run, f"rid long, doc_id {kind}, n_shingles long, name binary, sketch binary")


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, SKETCH)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _roots(reps: DataFrame) -> DataFrame:
    """``(path, rid)``: the documents' nodes on the first level of each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            places = np.arange(TREES) * (SKETCH // TREES)
            path = mix((np.arange(1, TREES + 1, dtype=np.uint64) << np.uint64(32)) | _sketches(batch.column(1).to_pylist())[:, places].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(path.reshape(-1).view(np.int64)), pa.array(np.repeat(_numbers(batch.column(0)), TREES))], names=["path", "rid"])

    return reps.select("rid", "sketch").mapInArrow(run, "path long, rid long")


_ROW = "path long, rid long, label long, n_shingles long, sketch binary"


def _branch(rows: DataFrame, level: int) -> DataFrame:
    """The next level's rows from these of ``_ROW``: two children for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            path, sketch, new = _numbers(batch.column(0)).view(np.uint64), _sketches(batch.column(4).to_pylist()), []
            for c in range(2):
                place = mix(path + np.uint64(level * 16 + c)) % np.uint64(SKETCH)
                new.append(mix(path ^ mix((place << np.uint64(32)) | sketch[np.arange(len(path)), place.astype(np.int64)].astype(np.uint64))))
            for c in range(2):
                keep = np.flatnonzero(new[1] != new[0]) if c else np.arange(len(path))  # both children may be one
                yield pa.RecordBatch.from_arrays([pa.array(new[c][keep].view(np.int64)), *(x.take(pa.array(keep)) for x in batch.columns[1:])], names=batch.schema.names)

    return rows.select("path", "rid", "label", "n_shingles", "sketch").mapInArrow(run, _ROW)


_PAIRS = "a long, b long, agree int"


def _pair_batch(a: np.ndarray, b: np.ndarray, agree: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(agree.astype(np.int32))], names=["a", "b", "agree"])


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Whole numbers and nulls."""
    return pd.DataFrame({c: pd.array([r[i] for r in rows], "Int64") for i, c in enumerate(columns)})


def _compare(rows: DataFrame) -> DataFrame:
    """Pairs within each node of ``(path, rid, label, sketch)`` whose labels differ and whose sketches agree enough; no node is large."""

    def pairs(path: np.ndarray, rid: np.ndarray, label: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        out = [(np.zeros(0, np.int64),) * 3]
        for k in range(1, len(path)):
            i = np.flatnonzero(path[k:] == path[:-k])
            if not len(i):
                break
            i = i[label[i] != label[i + k]]
            for part in np.array_split(i, len(i) // 20_000 + 1):
                agree = (sketch[part] == sketch[part + k]).sum(axis=1)
                hit = agree >= AGREE
                out.append((rid[part[hit]], rid[part[hit] + k], agree[hit]))
        return _pair_batch(*(np.concatenate(x) for x in zip(*out, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = (*(_numbers(batch.column(i)) for i in range(3)), _sketches(batch.column(3).to_pylist()))
            if rest:
                part = tuple(np.concatenate(x) for x in zip(rest, part, strict=True))
            other = np.flatnonzero(part[0] != part[0][-1])
            cut = other[-1] + 1 if len(other) else 0
            rest = tuple(x[cut:] for x in part)  # the last node may go on
            if cut:
                yield pairs(*(x[:cut] for x in part))
        if rest:
            yield pairs(*rest)

    return rows.select("path", "rid", "label", "sketch").repartition("path").sortWithinPartitions("path", "rid").mapInArrow(run, _PAIRS)


def _led(large: DataFrame) -> DataFrame:
    """Pairs of large nodes' documents (``path, rid, sketch, c``) with their chunks' leaders, and of these with one of the node's."""

    def lead(part: pd.DataFrame) -> pd.DataFrame:
        rid, sketch, out = part.rid.to_numpy(), _sketches(part.sketch), []
        left = np.arange(len(rid))
        for turn in range(LEADERS):
            own = sketch[left]
            in_order = np.sort(own, axis=0)
            common = np.empty(SKETCH, np.uint32)
            for j in range(SKETCH):
                first = np.flatnonzero(np.concatenate([[True], in_order[1:, j] != in_order[:-1, j]]))
                common[j] = in_order[first[np.diff(np.concatenate([first, [len(left)]])).argmax()], j]
            fits = (own == common).sum(axis=1)
            leader = int(left[fits.argmax()])
            agree = (own == sketch[leader]).sum(axis=1)
            if not turn:
                out.append((part.path.iloc[0], rid[leader], None, int(fits.max())))
            near = agree >= AGREE
            out += [(None, rid[i], rid[leader], int(x)) for i, x in zip(left[near], agree[near], strict=True) if i != leader]
            left = left[~near]
            if near.sum() < 3 or len(left) < 3:
                break
        return _frame(out, ["path", "a", "b", "agree"])

    chunk = F.pmod(F.xxhash64("path", "rid"), F.ceil(F.col("c") / CHUNK))
    found = store(large.groupBy("path", chunk.alias("chunk")).applyInPandas(lead, "path long, a long, b long, agree int"), "led")
    of_node = found.filter("path is not null").groupBy("path").agg(F.max_by("a", F.struct("agree", "a")).alias("leader"))
    leaders = found.filter("path is not null").select("path", "a").join(of_node, "path").select("a", F.col("leader").alias("b"), F.lit(AGREE).alias("agree"))
    pairs = found.filter("path is null").select("a", "b", "agree").unionByName(leaders).filter("a != b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "agree")


def _best(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.max("agree").alias("agree"))


def first_candidates(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b, agree)``, a < b, of the first level: within small nodes, and with the leaders of large ones; and the rows of large nodes."""
    rows = store(_roots(reps), "roots")
    counts = store(rows.groupBy("path").agg(F.count("*").alias("c")).filter("c > 1"), "counts")
    named = lambda which: rows.join(counts.filter(which), "path").join(reps, "rid")
    tiny = _compare(named(F.col("c") <= TINY).withColumn("label", F.col("rid")))
    large = store(named(F.col("c") > TINY).select("path", "rid", "n_shingles", "sketch", "c"), "large")
    return store(_best(tiny.unionByName(_led(large))), "pairs"), large.drop("c")


def later_candidates(large: DataFrame, labels: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From the first level's large nodes and those below them: pairs of different components, and links that are confirmed already."""
    spark = docs.sparkSession
    label = labels.select(F.col("v").alias("rid"), F.col("c").alias("label"))
    rows = store(large.join(label, "rid", "left").select("path", "rid", F.coalesce("label", "rid").alias("label"), "n_shingles", "sketch"), "nodes1")
    mixed, count = [], lambda n: F.ceil(n).cast("int")
    for level in range(1, LEVELS + 1):
        per = rows.groupBy("path", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).groupBy("path").agg(
            F.sum("n").alias("t"), F.max("n").alias("m"), F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("s").alias("all"), F.max_by("s", F.struct("n", "label")).alias("own")
        )
        per = per.filter("t > m").select(  # nodes of one component are done
            "path", "t", "main", ((F.col("t") - F.col("m") <= SMALL) | F.lit(level == LEVELS)).alias("ends"), count(F.greatest(F.col("t") / CHUNK, F.col("all") / BLOCK)).alias("blocks"),
            count(F.greatest((F.col("t") - F.col("m")) / SMALL, (F.col("all") - F.col("own")) / BLOCK)).alias("probes"),
        )
        rows = store(rows.join(per, "path").withColumn("rest", F.col("label") != F.col("main")), f"mixed{level}")
        mixed.append(rows.filter("ends"))
        rows = rows.filter("not ends")
        if rows.isEmpty():
            break
        rows = store(_branch(rows, level), f"nodes{level + 1}")
    mixed = _union(mixed)
    links = spark.createDataFrame([], "a long, b long")
    compared = store(_compare_rest(mixed.filter(F.col("t") > TINY)), "compared")
    pairs = _best(_compare(mixed.filter(F.col("t") <= TINY)).unionByName(compared.filter("path is null").select("a", "b", "agree")))
    dense = compared.filter("path is not null").select("path", "block", "probe", F.col("a").alias("rid"))
    if not dense.isEmpty():
        links = _dense_links(dense, mixed, docs)
    return store(pairs, "more"), links


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _compare_rest(rows: DataFrame) -> DataFrame:
    """Nodes' documents (``_ROW, blocks, probes, rest``) outside of the main component against all others: both are dealt
    to blocks, and each pair of blocks is compared by itself. ``(path, block, probe, a, b, agree)``: pairs, without a path; or, for a
    document with more than FEW near ones in a block, the block, which is then compared on full sets."""

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        asks = part.asks.to_numpy(bool)
        rid, label, sketch = part.rid.to_numpy(), part.label.to_numpy(), _sketches(part.sketch)
        others, out = np.flatnonzero(~asks), []
        sketch_of_others = sketch[others]
        for i in np.flatnonzero(asks):
            agree = (sketch_of_others == sketch[i]).sum(axis=1)
            near = np.flatnonzero((agree >= AGREE) & (label[others] != label[i]))
            if len(near) > FEW:
                out.append((part.path.iloc[0], part.block.iloc[0], part.probe.iloc[0], rid[i], None, None))
            else:
                out += [(None, None, None, min(rid[i], rid[j]), max(rid[i], rid[j]), n) for j, n in zip(others[near], agree[near], strict=True)]
        return _frame(out, ["path", "block", "probe", "a", "b", "agree"])

    return _asked(rows, "sketch").groupBy("path", "block", "probe").applyInPandas(compare, "path long, block int, probe int, a long, b long, agree int")


def _asked(rows: DataFrame, *columns: str) -> DataFrame:
    """The members of each block, once for each block of asking documents, and these once for each block of members."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = rows.withColumns({"block": F.pmod(F.xxhash64("path", "rid"), F.col("blocks")).cast("int"), "probe": F.pmod(F.xxhash64("rid", "path"), F.col("probes")).cast("int")})
    columns = ["path", "block", "probe", "asks", "rid", "label", *columns]
    members = rows.withColumn("probe", every("probes")).withColumn("asks", F.lit(False)).select(columns)
    return members.unionByName(rows.filter("rest").withColumn("block", every("blocks")).withColumn("asks", F.lit(True)).select(columns))


def _dense_links(dense: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Links on full sets between the asking documents of ``dense`` (path, block, probe, rid) and the members of their blocks of ``rows``."""
    keys = ["path", "block", "probe"]

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        asks, rid, label = part.asks.to_numpy(bool), part.rid.to_numpy(), part.label.to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in part.shingles]
        others, out = np.flatnonzero(~asks), []
        sizes = np.array([len(sets[j]) for j in others])
        known, code = np.unique(np.concatenate([sets[j] for j in others]), return_inverse=True)
        starts, mine = np.cumsum(sizes) - sizes, np.zeros(len(known), np.int64)
        for i in np.flatnonzero(asks):
            at = np.minimum(np.searchsorted(known, sets[i]), len(known) - 1)
            at = at[known[at] == sets[i]]
            mine[at] = 1
            both = np.add.reduceat(mine[code], starts)
            mine[at] = 0
            hit = others[(label[others] != label[i]) & (100 * both >= PERCENT * (len(sets[i]) + sizes - both))]
            # one link to each component is enough
            out += [(min(rid[i], rid[j]), max(rid[i], rid[j])) for j in hit[np.unique(label[hit], return_index=True)[1]]]
        return pd.DataFrame(out, columns=["a", "b"])

    asked = _asked(rows)
    members = asked.filter("not asks").join(dense.select(keys).distinct(), keys, "left_semi")
    asking = asked.filter("asks").join(dense, [*keys, "rid"], "left_semi").select(members.columns)
    both = store(members.unionByName(asking), "dense_rows")
    sets = _full_sets(both.select("rid"), docs)
    return store(both.join(sets, "rid").groupBy(*keys).applyInPandas(compare, "a long, b long").distinct(), "dense_links")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b), those whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_numbers(batch.column(i)) for i in (0, 1))
            hit = np.zeros(len(a), bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                short, long = sorted((one, two), key=len)
                both = int((long[np.minimum(np.searchsorted(long, short), len(long) - 1)] == short).sum())
                hit[k] = 100 * both >= PERCENT * (len(one) + len(two) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[hit]), pa.array(b[hit])], names=["a", "b"])

    of = lambda side: sets.select(F.col("rid").alias(side), F.col("shingles").alias(f"of_{side}"))
    return pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def _full_sets(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """``(rid, shingles)`` of the documents in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in by_size(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in shingle_sets(texts)], pa.binary())], names=["rid", "shingles"])

    return store(pick_rows(rows.select("rid", "text"), ids, "left_semi").mapInArrow(run, "rid long, shingles binary"), "full_sets")


def _open(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs that are not known to be in one component."""
    of = lambda side: labels.select(F.col("v").alias(side), F.col("c").alias(f"c{side}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "agree")


def first_labels(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The components ``(v, c)`` that ``pairs`` give: each document's best pair is confirmed first, then what is still open."""
    if pairs.isEmpty():
        return store(rows.sparkSession.createDataFrame([], "v long, c long"), "labels")
    sets = _full_sets(pairs.select(F.explode(F.array("a", "b")).alias("rid")), rows)
    side = lambda v, o: pairs.select(F.col(v).alias("v"), F.struct("agree", (-F.col(o)).alias("o")).alias("p"))
    top = side("a", "b").unionByName(side("b", "a")).groupBy("v").agg(F.max("p").alias("p"))
    top = store(top.select(F.least("v", -F.col("p.o")).alias("a"), F.greatest("v", -F.col("p.o")).alias("b")).distinct(), "top")
    labels = components(confirmed(top, sets))
    rest = _open(pairs, labels).join(top, ["a", "b"], "left_anti")
    return with_links(labels, store(confirmed(rest, sets), "links"))


def more_labels(pairs: DataFrame, links: DataFrame, labels: DataFrame, rows: DataFrame) -> DataFrame:
    """``labels`` after ``links`` and what of ``pairs`` is confirmed."""
    pairs = store(_open(pairs, labels), "open")
    if not pairs.isEmpty():
        links = links.unionByName(confirmed(pairs, _full_sets(pairs.select(F.explode(F.array("a", "b")).alias("rid")), rows)))
    return with_links(labels, store(links, "links"))


def with_links(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (v, c) after more links: components of the graph whose vertices are the components so far, which is small."""
    if links.isEmpty():
        return labels
    ends = links.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    known = store(labels.unionByName(ends.join(labels, "v", "left_anti").select("v", F.col("v").alias("c"))), "known")
    of = lambda side: known.select(F.col("v").alias(side), F.col("c").alias(f"c{side}"))
    between = store(links.join(of("a"), "a").join(of("b"), "b").filter("ca != cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "between")
    if between.isEmpty():
        return known
    joined = components(between).select(F.col("v").alias("c"), F.col("c").alias("root"))
    return store(known.join(joined, "c", "left").select("v", F.coalesce("root", "c").alias("c")), "joined")


def components(links: DataFrame) -> DataFrame:
    """``(v, c)``: for each end of ``links`` (a, b), the smallest end that it is connected with."""
    both = store(links.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(links.select(F.col("b").alias("v"), F.col("a").alias("w"))), "ends")
    labels = store(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("c")), "labels0")
    k = 0
    while True:
        k += 1
        near = both.join(labels.withColumnsRenamed({"v": "w", "c": "cw"}), "w").groupBy("v").agg(F.min("cw").alias("m"))
        step = store(labels.join(near, "v").select("v", "c", F.least("c", "m").alias("n")), f"step{k}")
        jump = step.select(F.col("v").alias("n"), F.col("n").alias("far"))
        new = store(step.join(jump, "n", "left").select("v", F.coalesce("far", "n").alias("c"), (F.coalesce("far", "n") != F.col("c")).alias("moved")), f"labels{k}")
        labels = new.select("v", "c")
        if new.filter("moved").isEmpty():
            return labels


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept`` and ``rid``, the row's number (column ``row``, if it has one)."""
    with scratch(docs.sparkSession):
        own = [F.col(row).alias("rid")] if row else []
        rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *own)
        rows = rows if row else with_row_id(rows)
        sketches = store(sketched(rows), "sketches")
        sets = store(sketches.filter("n_shingles > 0").groupBy("name", "n_shingles").agg(F.min("rid").alias("rep")), "sets")
        reps = store(sketches.join(sets.select(F.col("rep").alias("rid")), "rid", "left_semi").select("rid", "n_shingles", "sketch"), "reps")
        pairs, large = first_candidates(reps)
        labels = first_labels(pairs, rows)
        pairs, links = later_candidates(large, labels, rows)
        labels = more_labels(pairs, links, labels, rows)

        named = sketches.select("rid", "doc_id", "n_shingles", "name").join(sets, ["name", "n_shingles"], "left")
        full = named.join(labels.withColumnRenamed("v", "rep"), "rep", "left").select("rid", "doc_id", "n_shingles", F.coalesce("c", "rep", "rid").alias("c"))
        full = store(full, "placed")
        order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("rid").alias("row"))
        groups = store(full.groupBy("c").agg(F.min(order).alias("best")), "components")
        return kept(full.join(groups, "c").select("doc_id", "n_shingles", F.col("best.id").alias("component_id"), (F.col("best.row") == F.col("rid")).alias("kept"), "rid"), "near_groups")


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component; all columns stay."""
    rows = with_row_id(docs, "__row")
    return drop_rows(rows, near_groups(rows, text, doc_id, "__row").filter("not kept"), "__row")
