"""Exact deduplication by deterministic block naming.

Every normalised text is cut into blocks of a fixed size. Sorting the distinct blocks gives each an integer name; then
adjacent names are paired, the distinct pairs are sorted and named in turn, and so on until one name is left for
each document. Two texts are equal exactly when they have the same number of levels and the same last name: names are
given to contents, not to hashes, so nothing can collide. The number of levels is the logarithm of the longest
text's number of blocks.

Only DataFrame functions are used. Distinct blocks are found with map-side combining, so a text with many copies
sends one row from each map task. The way back from a block to its name is a sort-merge join of two plain exchanges,
of which adaptive execution splits those partitions that a hot block makes large.

Edge cases: null and empty texts, and texts of white space alone, are equal to each other (the empty text). Null ids
are kept and lose ties to real ids. Fully repeated rows are told apart by their place, so exactly one row of each group
is kept. Very long texts are read whole, as more blocks and levels. Other columns take no part, and columns of any name are allowed in ``docs``. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.llm.common import SPACES, drop_rows, kept, scratch, store, with_row_id

#: Code points in a block.
BLOCK = 4096


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Integer names in the order of a sort: the partition's number, then the place in the sorted partition."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """``(rid, levels, name, n_chars, text_sha256)``: (levels, name) is the collision-free identity of the row's normalised text."""
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.regexp_replace(raw, SPACES, "").alias("norm"), F.char_length(raw).alias("n_chars"), "rid")
    n = F.greatest(F.ceil(F.char_length("norm") / block), F.lit(1)).cast("int")
    blocks = rows.select(
        "rid", "n_chars", n.alias("n_blocks"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("norm", i * block + 1, F.lit(block)))).alias("pos", "block"),
    )
    names = store(_named(blocks.select("block").distinct(), ["block"]), "blocks")
    level = store(blocks.join(names, "block").drop("block"), "names0")
    meta = level.filter("pos = 0").select("rid", "n_chars", "text_sha256", "n_blocks")
    done = level.filter("n_blocks = 1").select("rid", F.lit(0).alias("levels"), "name")
    most = level.agg(F.max("n_blocks")).first()[0] or 1
    level = level.filter("n_blocks > 1").select("rid", "pos", "n_blocks", "name")
    depth = 0
    while most > 1:
        depth, most = depth + 1, (most + 1) // 2
        half = F.col("pos") % 2 == 0
        pairs = level.groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("pos"), F.ceil(F.col("n_blocks") / 2).cast("int").alias("n_blocks")).agg(
            F.max(F.when(half, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(~half, F.col("name"))), F.lit(-1).cast("long")).alias("right")
        )
        pairs = store(pairs, f"pairs{depth}")
        names = store(_named(pairs.select("left", "right").distinct(), ["left", "right"]), f"pair_names{depth}")
        level = store(pairs.join(names, ["left", "right"]).select("rid", "pos", "n_blocks", "name"), f"names{depth}")
        done = done.unionByName(level.filter("n_blocks = 1").select("rid", F.lit(depth).alias("levels"), "name"))
        level = level.filter("n_blocks > 1")
    return meta.drop("n_blocks").join(done, "rid")


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK, row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256`` and ``rid``, the row's number (column ``row``, if it has one).

    Of equal texts (after white space is deleted), the row with the most code points in its original text stays, then
    the one with the smallest id.
    """
    with scratch(docs.sparkSession):
        own = [F.col(row).alias("rid")] if row else []
        rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *own)
        rows = rows if row else with_row_id(rows)
        known = store(identities(rows, "text", block).join(rows.select("rid", "doc_id"), "rid"), "identities")
        order = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("rid").alias("row"))
        groups = store(known.groupBy("levels", "name").agg(F.min(order).alias("best"), F.count("*").alias("group_size")), "groups")
        out = known.join(groups, ["levels", "name"]).select(
            "doc_id", F.col("best.id").alias("keep_id"), "group_size", (F.col("best.row") == F.col("rid")).alias("kept"), "text_sha256", "rid"
        )
        return kept(out, "exact_groups")


def drop_exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that :func:`exact_groups` does not keep; all columns stay."""
    rows = with_row_id(docs, "__row")
    return drop_rows(rows, exact_groups(rows, text, doc_id, row="__row").filter("not kept"), "__row")
