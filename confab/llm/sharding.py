"""K-d tree sharding: documents are split at weighted medians along the widest dimension until leaves reach a size.

Each level of the tree is a handful of aggregations over a narrow table of (coordinates, bytes); texts are read
once and never shuffled. A node that shall give n leaves is split so that floor(n/2)/n of its bytes go left. The
weighted median is found by refining histograms: bytes are summed by (node, bin), with map-side combining, and the bin that
holds the median is divided again until it holds one value only. Where many rows share that value, the cut goes
through them in the order of a second key, refined alike, so a hot value is split and leaves stay near equal.

Edge cases: a null coordinate sorts before all others; text coordinates sort by their whole values. Null texts
have no bytes but weigh 1. Rows that agree in all keys, repeated ones above all, cannot be told apart by a cut and stay together. Very long texts are a row as any other: none is cut. Fewer rows
than leaves leave some shards empty; an empty table gives no rows. Columns ``shard`` and ``slot`` are replaced by the results; others stay, whatever their names but for those that begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confab.llm.common import store

#: Rows of a slot block: within one, a window numbers the rows; blocks are chained by their counts.
SLOT_ROWS = 20_000


def _with_coordinates(docs: DataFrame, dims: list[str]) -> DataFrame:
    """``docs`` with ``__c``, a struct of numbers that sort as the columns do; nulls come first. Texts get the places of their values in the order of all distinct ones."""
    kinds, columns = dict(docs.dtypes), []
    for i, name in enumerate(dims):
        if kinds[name] == "string":
            values = docs.select(F.col(name).alias("__value")).filter("__value is not null").distinct().repartitionByRange("__value").sortWithinPartitions("__value")
            values = store(values.withColumn(f"__place{i}", F.monotonically_increasing_id().cast("double")), "places")
            docs = docs.join(values, docs[name] == values["__value"], "left").drop("__value")
            columns.append(F.coalesce(F.col(f"__place{i}"), F.lit(float("-inf"))).alias(str(i)))
        else:
            columns.append(F.coalesce(F.col(name).cast("double"), F.lit(float("-inf"))).alias(str(i)))
    return docs.withColumn("__c", F.struct(*columns)).drop(*(f"__place{i}" for i in range(len(dims))))


def _cuts(rows: DataFrame, wanted: dict[int, float], bins: int) -> dict[int, tuple[float, float]]:
    """For each node, the value x at which the bytes of smaller keys pass the wanted number, and the bytes below x.

    ``rows``: node, key, bytes. Per round, one row for each node and bin reaches the driver.
    """
    spark, found, base = rows.sparkSession, {}, dict.fromkeys(wanted, 0.0)
    span = {r[0]: (r[1], r[2]) for r in rows.groupBy("node").agg(F.min("key"), F.max("key")).collect()}
    while span:
        todo = spark.createDataFrame([(n, a, b) for n, (a, b) in span.items()], "node int, low double, high double")
        inside = rows.join(F.broadcast(todo), "node").filter("key >= low and key <= high")
        low = F.when(F.col("low") == float("-inf"), F.lit(-1.0)).otherwise(F.col("low"))
        key = F.when(F.col("key") == float("-inf"), F.lit(-1.0)).otherwise(F.col("key"))
        at = F.when(F.col("high") > low, F.least(F.floor((key - low) / (F.col("high") - low) * bins), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
        sums = inside.groupBy("node", at.alias("bin")).agg(F.sum("bytes").cast("double").alias("w"), F.min("key").alias("a"), F.max("key").alias("b"))
        by: dict[int, list] = {}
        for n, i, w, a, b in sums.collect():
            by.setdefault(n, []).append((i, w, a, b))
        span = {}
        for n, found_bins in by.items():
            for _, w, a, b in sorted(found_bins):
                if base[n] + w > wanted[n] or a == max(x[2] for x in found_bins):
                    span[n] = (a, b)
                    if a == b:
                        found[n] = (a, base[n])
                        del span[n]
                    break
                base[n] += w
    return found


def kd_shards(docs: DataFrame, dims: list[str], size: str, tie: Column, n_leaves: int | None = None, target_bytes: int | None = None, shares: list[float] | None = None) -> DataFrame:
    """``docs`` (narrow: no texts) with ``shard``, 0 to the number of leaves less 1.

    ``dims``: the columns along which nodes may be split; ``size``: a row's bytes; ``tie``: a number by which rows of
    the same coordinate are ordered. Leaves: ``n_leaves``, or so many that each has about ``target_bytes``. ``shares``: what each
    leaf shall have of all bytes, if not as much as the others.
    """
    spark = docs.sparkSession
    coordinates = [F.col(f"__c.{i}") for i in range(len(dims))]
    rows = _with_coordinates(docs.withColumns({"__t": tie.cast("double"), "__node": F.lit(0)}), dims)
    total = docs.agg(F.sum(size)).first()[0] or 0
    leaves = {0: n_leaves or max(1, -(-total // target_bytes))}
    first_leaf = {0: 0}
    below = lambda n, k: sum(shares[first_leaf[n] : first_leaf[n] + k]) if shares else float(k)
    widths = None
    depth = 0
    while any(n > 1 for n in leaves.values()):
        nodes = [n for n in leaves if leaves[n] > 1]
        bins = max(16, min(2048, 500_000 // len(nodes)))
        stats = rows.groupBy(F.col("__node").alias("node")).agg(F.sum(size).alias("w"), *[f(F.when(c != float("-inf"), c)).alias(f"{k}{i}") for i, c in enumerate(coordinates) for k, f in (("a", F.min), ("b", F.max))]).collect()
        spread = {r["node"]: [max(0.0, (r[f"b{i}"] or 0) - (r[f"a{i}"] or 0)) for i in range(len(dims))] for r in stats}
        widths = widths or spread.get(0) or [0.0] * len(dims)
        weight = {r["node"]: float(r["w"]) for r in stats}
        widest = {n: max(range(len(dims)), key=lambda i: (spread[n][i] / widths[i] if widths[i] else 0, -i)) for n in nodes if n in spread}  # noqa: B023
        left = {n: leaves[n] // 2 for n in nodes}
        wanted = {n: weight[n] * below(n, left[n]) / (below(n, leaves[n]) or 1.0) for n in widest}
        pick = spark.createDataFrame([(n, i) for n, i in widest.items()], "__node int, __dim int")
        keyed = rows.join(F.broadcast(pick), "__node").select(F.col("__node").alias("node"), F.element_at(F.array(*coordinates), F.col("__dim") + 1).alias("key"), F.col("__t"), F.col(size).alias("bytes"))
        first = _cuts(keyed.select("node", "key", "bytes"), wanted, bins) if widest else {}
        at = spark.createDataFrame([(n, x) for n, (x, _) in first.items()], "node int, cut double")
        tied = keyed.join(F.broadcast(at), "node").filter("key = cut").select("node", F.col("__t").alias("key"), "bytes")
        second = _cuts(tied, {n: wanted[n] - below for n, (_, below) in first.items()}, bins) if first else {}
        base, new_base, new_leaves, at_leaf = {}, 0, {}, 0
        first_leaf = {}
        for n in sorted(leaves):  # children are numbered from left to right
            base[n] = new_base
            for part in ([left[n], leaves[n] - left[n]] if leaves[n] > 1 else [leaves[n]]):
                new_leaves[new_base], first_leaf[new_base] = part, at_leaf
                new_base, at_leaf = new_base + 1, at_leaf + part
        table = [(n, widest.get(n, -1), first[n][0] if n in first else None, second[n][0] if n in second else None, base[n]) for n in leaves]
        cut = spark.createDataFrame(table, "__node int, __dim int, __cut double, __tie double, __base int")
        key = F.element_at(F.array(*coordinates), F.col("__dim") + 1)
        right = F.when(F.col("__cut").isNull(), 0).when((key > F.col("__cut")) | ((key == F.col("__cut")) & (F.col("__t") >= F.col("__tie"))), 1).otherwise(0)
        rows = rows.join(F.broadcast(cut), "__node").withColumn("__node", (F.col("__base") + right).cast("int")).drop("__dim", "__cut", "__tie", "__base")
        leaves, depth = new_leaves, depth + 1
        if depth % 4 == 0:
            rows = store(rows, f"level{depth}")
    return rows.withColumn("shard", F.col("__node")).drop("__c", "__t", "__node")


#: Groups of equal texts with at least this share of a shard are placed by themselves.
HEAVY = 1 / 500


def balanced_shards(sizes: DataFrame, dims: list[str], n: int) -> DataFrame:
    """``sizes`` (of :func:`document_sizes`) in n shards of near equal bytes, in which groups of equal texts are whole.

    Groups of HEAVY to 1 times a shard's share go, the largest first, to the shards that have the least so far; there are at most ``n / HEAVY`` of
    them, which the driver deals out. All other rows are split by the k-d tree, whose leaves fill the shards up; its cuts keep equal texts on one side. Only groups of more
    bytes than a shard has are cut through, in the order of a hash of their ids."""
    spark = sizes.sparkSession
    total = sizes.agg(F.sum("size")).first()[0] or 0
    keys = ["text_crc32", "size", "text_key"]
    groups = sizes.groupBy(*keys).agg(F.sum("size").alias("bytes")).filter(F.col("bytes") >= max(1.0, total / n * HEAVY)).filter(F.col("bytes") > F.col("size"))
    groups = sorted(groups.collect(), key=lambda r: (-r.bytes, r.text_crc32, r.size, r.text_key))
    load, placed = [0] * n, []
    for r in groups:
        if r.bytes <= total / n:
            to = min(range(n), key=lambda i: (load[i], i))
            load[to] += r.bytes
        else:
            to = None  # too large for one shard
        placed.append((r.text_crc32, r.size, r.text_key, to))
    table = spark.createDataFrame(placed, "text_crc32 long, size long, text_key long, __shard int").withColumn("__heavy", F.lit(True))
    # at most n / HEAVY rows
    rows = sizes.join(F.broadcast(table), keys, "left")
    loose = F.when(F.col("__heavy"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))).otherwise(0)
    rest = kd_shards(rows.filter("__shard is null"), dims, "size", F.col("text_crc32") * F.lit(1 << 20) + loose, n_leaves=n, shares=[max(0.0, total / n - x) for x in load])
    return rest.drop("__shard", "__heavy").unionByName(rows.filter("__shard is not null").withColumn("shard", F.col("__shard")).drop("__shard", "__heavy"))


def with_slots(rows: DataFrame, group: str, order: Column, slot: str = "slot") -> DataFrame:
    """A gapless number from 0 for each row of a group. Rows are dealt to blocks by a hash, numbered within them, and
    blocks are chained by prefix sums over their counts, so no task holds a whole group."""
    from pyspark.sql import Window as W

    total = rows.count()
    blocks = max(1, -(-total // SLOT_ROWS))
    dealt = rows.withColumn("__block", F.pmod(F.xxhash64(order), F.lit(blocks)))
    dealt = store(dealt.withColumn("__n", F.row_number().over(W.partitionBy(group, "__block").orderBy(order)) - 1), "slots")
    counts = dealt.groupBy(group, "__block").agg(F.count("*").alias("__k"))
    counts = counts.withColumn("__from", F.coalesce(F.sum("__k").over(W.partitionBy(group).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__k")
    return dealt.join(counts, [group, "__block"]).withColumn(slot, (F.col("__from") + F.col("__n")).cast("long")).drop("__block", "__n", "__from")


def document_sizes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, size, text_crc32, n_chars, text_key``: what sharding needs to know of each document."""
    raw = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.char_length(raw).cast("long").alias("n_chars"),
        F.xxhash64(raw).alias("text_key"),
    )
