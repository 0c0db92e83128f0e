"""Report prompts: blocks of rendered lines per chat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confab.functions.text import render_line
from confab.operators.order import place_in_order, running


# A8
def report_blocks(messages: DataFrame) -> DataFrame:
    """One block per chat, ``position`` being that of its first message: a header and its lines in order."""
    line = render_line(F.col("time"), F.col("sender"), F.col("type"), F.col("content"))
    place = F.struct("source_path", "msg_index")
    blocks = messages.groupBy("chat_name").agg(F.min(place).alias("position"), F.array_sort(F.collect_list(F.struct(place.alias("p"), line.alias("line")))).alias("lines"))
    return blocks.select("chat_name", "position", F.concat(F.lit("## "), "chat_name", F.lit("\n"), F.array_join("lines.line", "\n")).alias("block"))


def report_parts(messages: DataFrame, most: int = 1 << 20) -> DataFrame:
    """``chat_name, part, block``: each chat's block (:func:`report_blocks`) in parts of at most ``most`` bytes, which follow one another without anything between.

    A part begins where the bytes before it pass a multiple of half of ``most``; units longer than a quarter of it are cut, so none is lost and none is larger. A chat's bytes are summed in
    ranges, so a chat of any size is the work of many tasks, and no row holds more than one part."""
    piece = max(1, most // 16)  # characters, of four bytes at most
    line = render_line(F.col("time"), F.col("sender"), F.col("type"), F.col("content"))
    first = messages.groupBy("chat_name").agg(F.min(F.struct("source_path", "msg_index")).alias("__p")).select(F.col("chat_name"), F.lit(-1).alias("at"), F.col("__p.source_path").alias("source_path"), F.col("__p.msg_index").alias("msg_index"), F.concat(F.lit("## "), "chat_name").alias("text"))
    lines = messages.select("chat_name", F.lit(0).alias("at"), "source_path", "msg_index", F.concat(F.lit("\n"), line).alias("text"))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.char_length("text") / piece) - 1, F.lit(0)).cast("int")), lambda i: F.substring("text", i * piece + 1, F.lit(piece)))
    units = first.unionByName(lines).filter("chat_name IS NOT NULL").select("chat_name", "at", "source_path", "msg_index", F.posexplode(cut).alias("nth", "text"))
    placed = running(units, ["chat_name"], [F.col(c) for c in ("at", "source_path", "msg_index", "nth")], "__before", F.octet_length("text"))
    part = F.floor(F.col("__before") / max(1, most // 2)).cast("int")
    whole = placed.groupBy("chat_name", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("__before", "at", "source_path", "msg_index", "nth", "text"))).alias("units"))
    # parts are numbered without gaps
    return whole.select("chat_name", (F.row_number().over(W.partitionBy("chat_name").orderBy("part")) - 1).alias("part"), F.array_join("units.text", "").alias("block"))


def report_prompt(messages: DataFrame, template: str = "{instructions}\n\n{blocks}\n", instructions: str = "Summarise the chats below.", chats: int = 100) -> DataFrame:
    """``prompt_pos, prompt``: the blocks of the chosen messages, joined by blank lines, in the caller's template; up to ``chats`` blocks go into a prompt, in
    order, so a few chats make one prompt and many make many."""
    numbered = place_in_order(report_blocks(messages).select("position", "block"), F.col("position"), "__n")
    joined = numbered.groupBy(F.floor(F.col("__n") / chats).cast("int").alias("prompt_pos")).agg(F.array_sort(F.collect_list(F.struct("__n", "block"))).alias("b"))
    head, _, tail = template.replace("{instructions}", instructions).partition("{blocks}")
    return joined.select("prompt_pos", F.concat(F.lit(head), F.array_join("b.block", "\n\n"), F.lit(tail)).alias("prompt"))
