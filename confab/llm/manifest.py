"""A Merkle manifest of a dataset: one hash for all rows, and for each row a proof that it belongs to it.

Rows are leaves. Within a group (a language, say) leaves are numbered in the order of their ids; every FAN consecutive nodes become their parent until one
node remains, the group's root. The groups' roots, in the order of the groups, become the dataset's root in the same way.

Nodes are labelled with nested intervals: a node carries the interval of leaf numbers that it covers, so one node is another's ancestor if its interval
contains the other's. A node of level l covers at most FAN ** l numbers from a multiple of it, so nodes meet their parents in an equality join on (group, level,
interval's bucket), with containment as its second condition. What a parent's interval has besides a child's own, to its left and to its right, are
the child's siblings. Proofs are built from the root down: each node below gets its ancestors' siblings with one join a level, and only the last join, of
the leaves with their parents, has as many rows as the table. Text is read once; no join moves it.

All of it runs in the JVM. Numbers come from a sort by range whose parts are counted and summed, so no group, however large, is in one task.

Edge cases: nulls in any column have an own form (``-``) and are leaves like others; an empty text has one too (``0:``). A null group is the first; null ids come
first in their group. Repeated rows are equal leaves side by side. A group of one leaf has that leaf as its root, and so has a dataset of one group; then a proof may have no siblings.
An empty table has no root and gives no rows. Of the table, only the named columns are read; extra ones, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confab.llm.common import kept, scratch, store

#: Nodes that become one.
FAN = 8
_STEPS = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex of the SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row's values, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    return digest(*[F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values])


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``lo``, each row's gapless number from 0 within its group, in the order of ``order`` (nulls first), and ``n``, the group's size."""
    place = F.monotonically_increasing_id()  # the partition's number, then the place in it
    dealt = store(rows.withColumn("__tie", place), "leaves")  # tells equal rows apart, so that these too are dealt to many ranges
    columns = [group, *order, "__tie"]
    ordered = store(dealt.repartitionByRange(*columns).sortWithinPartitions(*columns).drop("__tie").withColumn("__place", place).withColumn("__part", F.shiftright("__place", 33)), "ordered")
    # a row for each range and group in it
    parts = ordered.groupBy(group, "__part").agg(F.min("__place").alias("__first"), F.count("*").alias("__rows"))
    whole = W.partitionBy(group)
    before = F.coalesce(F.sum("__rows").over(whole.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"__before": before, "n": F.sum("__rows").over(whole)}).drop("__rows")
    return ordered.join(parts, [group, "__part"]).withColumn("lo", F.col("__before") + F.col("__place") - F.col("__first")).drop("__before", "__place", "__first", "__part")


def _nodes(level: int, fan: int) -> Column:
    """How many nodes a group of ``n`` leaves has at a level."""
    return F.ceil(F.col("n") / fan**level)


def parents(leaves: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """For each level from 1 on, its nodes: ``grp, n, lo, hi, hash, children``. ``leaves``: ``grp, n, lo, hash``."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    level, found = leaves.select("grp", "n", "lo", (F.col("lo") + 1).alias("hi"), "hash"), []
    while most > fan ** len(found):
        at = len(found) + 1
        child = F.struct("lo", "hi", "hash")
        level = level.filter(_nodes(at - 1, fan) > 1).groupBy("grp", "n", F.floor(F.col("lo") / fan**at).alias("bucket")).agg(F.sort_array(F.collect_list(child)).alias("children"))
        level = level.select("grp", "n", F.col("children")[0]["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi"), digest(F.array_join(F.transform("children", lambda c: c["hash"]), "")).alias("hash"), "children")
        found.append(level := store(level, f"level{at}"))
    return found


def roots(leaves: DataFrame, levels: list[DataFrame], fan: int = FAN) -> DataFrame:
    """``grp, hash``: each group's last node."""
    out = leaves.filter("n = 1").select("grp", "hash")
    for i, nodes in enumerate(levels):
        out = out.unionByName(nodes.filter(_nodes(i + 1, fan) == 1).select("grp", "hash"))
    return out


def _siblings(children: Column, lo: Column, hi: Column) -> Column:
    """What the children's parent covers besides the interval from ``lo`` to ``hi``: the hashes on its left and on its right."""
    of = lambda keep: F.array_join(F.transform(F.filter(children, keep), lambda c: c["hash"]), "")
    return F.struct(of(lambda c: c["hi"] <= lo).alias("left"), of(lambda c: c["lo"] >= hi).alias("right"))


def with_siblings(leaves: DataFrame, levels: list[DataFrame], above: DataFrame, fan: int = FAN) -> DataFrame:
    """``leaves`` (``grp, n, lo, ...``) with ``steps``, the siblings from the leaf's level up to the group's root and then those that ``above`` (``grp, steps, ...``) has for the
    group, and with the other columns of ``above``."""
    extra = [c for c in above.columns if c not in ("grp", "steps")]
    family, columns = None, ["grp", "lo", "hi", "children", "steps", *extra]
    for level in range(len(levels), 0, -1):
        nodes = levels[level - 1]
        found = nodes.filter(_nodes(level, fan) == 1).join(above, "grp").select(*columns)
        if family is not None:
            inner = family.select("grp", "children", "steps", *extra, F.explode("children").alias("c"))
            own = _siblings(F.col("children"), F.col("c.lo"), F.col("c.hi"))
            inner = inner.select("grp", F.col("c.lo").alias("in_lo"), F.col("c.hi").alias("in_hi"), F.concat(F.array(own), F.col("steps")).alias("steps"), *extra)
            found = found.unionByName(_contained(inner, nodes.filter(_nodes(level, fan) > 1).drop("n", "hash"), level, fan).select(*columns))
        family = found
    rows = leaves.withColumns({"in_lo": F.col("lo"), "in_hi": F.col("lo") + 1}).drop("lo")
    lone = rows.filter("n = 1").join(above, "grp").drop("in_lo", "in_hi", "n")
    if family is None:
        return lone
    met = _contained(rows.filter("n > 1"), family, 1, fan)
    own = _siblings(F.col("children"), F.col("in_lo"), F.col("in_hi"))
    return met.withColumn("steps", F.concat(F.array(own), F.col("steps"))).select(*lone.columns).unionByName(lone)


def _contained(inner: DataFrame, nodes: DataFrame, level: int, fan: int) -> DataFrame:
    """Intervals ``in_lo`` to ``in_hi`` with the node of the level whose interval contains them."""
    bucket = lambda lo: F.floor(F.col(lo) / fan**level)
    joined = inner.withColumn("bucket", bucket("in_lo")).alias("i").join(nodes.withColumn("bucket", bucket("lo")).alias("p"), ["grp", "bucket"])
    return joined.filter("in_lo >= p.lo AND in_hi <= p.hi").drop("bucket")


def proof(steps: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(hash_: Column, steps: Column) -> Column:
    """The root that follows from a leaf's hash and its siblings."""
    return F.aggregate(steps, hash_, lambda h, s: digest(s["left"], h, s["right"]))


def manifest(docs: DataFrame, columns: Sequence[str], group: str, order: str, changed: dict[str, Column] | None = None, fan: int = FAN) -> DataFrame:
    """For each row: ``order``'s column, ``leaf, subroot, root, proof_sha256, folded_root, verified``; the last two for the row as it is after ``changed``, which has other values for some columns."""
    with scratch(docs.sparkSession):
        return kept(_manifest(docs, columns, group, order, changed or {}, fan), "manifest")


def _manifest(docs: DataFrame, columns: Sequence[str], group: str, order: str, changed: dict[str, Column], fan: int) -> DataFrame:
    key = F.col(group).cast("string")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("1"), key), F.lit("0")).alias("grp"),  # sorts as the groups do, null first
        F.col(order).alias("__order"), leaf([F.col(c) for c in columns]).alias("hash"), leaf([changed.get(c, F.col(c)) for c in columns]).alias("now"),
    )
    leaves = store(numbered(rows, "grp", ["__order", "hash"]), "numbered")
    levels = parents(leaves, fan)
    subroots = roots(leaves, levels, fan).select(F.lit("").alias("grp"), F.col("grp").alias("member"), "hash")
    tops = store(numbered(subroots, "grp", ["member"]), "subroots")
    upper = parents(tops, fan)
    root = roots(tops, upper, fan).select("grp", F.col("hash").alias("root"), F.array().cast(_STEPS).alias("steps"))
    above = with_siblings(tops, upper, root, fan).select(F.col("member").alias("grp"), F.col("hash").alias("subroot"), "root", "steps")
    out = with_siblings(leaves, levels, store(above, "above"), fan)
    again = folded(F.col("now"), F.col("steps"))
    return out.select(F.col("__order").alias(order), F.col("hash").alias("leaf"), "subroot", "root", proof(F.col("steps")).alias("proof_sha256"), again.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
