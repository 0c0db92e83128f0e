"""Tables of recognised text lines: parsing, merging rows, best matches, titles."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from confab.functions import text as T
from confab.operators.names import titles_match

_POINT = re.compile(r"\(\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*\)")
_TAGGED = re.compile(r"<ref>(.*?)</ref>\s*<quad>(.*?)</quad>", re.S)
_PLAIN = re.compile(r"([^\n<>()]+?)\s*((?:\([^)]*\)\s*,\s*)+\([^)]*\))")


# M4
def lines_of(text: str | None, width: int, height: int) -> list[tuple[str, int, int, int, int]]:
    """Text lines with their boxes in pixels, from a recogniser's answer; tagged records, or else plain ones."""
    found = []
    for pattern in (_TAGGED, _PLAIN):
        for name, spots in pattern.findall(text or ""):
            name = unicodedata.normalize("NFKC", name).replace("…", "...").replace("⋯", "...").strip("\\ ")
            name = " ".join(name.split())
            points = [(float(x), float(y)) for x, y in _POINT.findall(spots)]
            if not name or len(points) < 2:
                continue
            flat = [abs(v) for p in points for v in p]
            sx = sy = 1.0
            if max(flat) <= 1:
                sx, sy = float(width), float(height)
            elif max(flat) <= 1000 and min(v for p in points for v in p) >= 0 and any(x > width or y > height for x, y in points):
                sx, sy = width / 1000, height / 1000
            xs, ys = [round(x * sx) for x, _ in points], [round(y * sy) for _, y in points]
            clip = lambda v, most: max(0, min(v, most))
            box = (clip(min(xs), width), clip(min(ys), height), clip(max(xs), width), clip(max(ys), height))
            if box[2] > box[0] and box[3] > box[1]:
                found.append((name, *box))
        if found:
            break
    return sorted(found, key=lambda r: ((r[2] + r[4]) // 2, r[1]))


def parse_ocr_text(answers: DataFrame) -> DataFrame:
    """OCRLINE rows of ``(image_id, text, width, height)``."""
    kind = answers.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answer, lines = [], []
            for i, (text, width, height) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                own = lines_of(text, width, height)
                answer += [i] * len(own)
                lines += [(k, *line) for k, line in enumerate(own)]
            columns = [pa.array([line[k] for line in lines], pa.string() if k == 1 else pa.int32()) for k in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(answer, pa.int64())), *columns, pa.array(np.ones(len(lines)))], names=["image_id", "line_pos", "text", "x1", "y1", "x2", "y2", "conf"])

    return answers.select("image_id", "text", "width", "height").mapInArrow(run, f"image_id {kind}, line_pos int, text string, x1 int, y1 int, x2 int, y2 int, conf double")


# W7
def merge_ocr_rows(lines: DataFrame, gap: int = 8) -> DataFrame:
    """Lines of one visual row become one: the topmost text and the box around all. A row ends where the next line starts below the one before."""
    centre = F.floor((F.col("y1") + F.col("y2")) / 2)
    w = W.partitionBy("image_id").orderBy("__c", "line_pos")
    rows = lines.withColumn("__c", centre)
    rows = rows.withColumn("__new", F.coalesce(F.col("y1") > F.lag("y2").over(w) + gap, F.lit(True)).cast("int"))
    rows = rows.withColumn("__g", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    top = F.struct("__c", "line_pos")
    return rows.groupBy("image_id", F.col("__g").cast("int").alias("row_pos")).agg(
        F.min_by("text", top).alias("text"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.min_by("conf", top).alias("conf")
    )


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _uncut_dots(c):
    return F.regexp_replace(c, r"(?U)(?:\.\.\.\s*)+$|\s+$", "")


# J7
def best_text_match(lines: DataFrame, targets: DataFrame, least: float = 0.55, ellipsis_only: bool = False) -> DataFrame:
    """For each (image, target) the first line that is the target or a cut-off form of it, else the most similar one.

    ``targets``: (image_id, target), so each image meets its own targets only. Only lines that match by no rule are compared by difflib."""
    norm = lambda c: T.squeeze(T.one_ellipsis(T.nfkc(F.coalesce(F.col(c), F.lit("")))))
    pairs = lines.withColumn("__t", norm("text")).join(targets.withColumn("__w", norm("target")), "image_id")

    def cut(short, long):
        stem = _uncut_dots(short)
        fits = (F.char_length(stem) >= 4) & (F.char_length(stem) < F.char_length(long)) & F.lower(long).startswith(F.lower(stem))
        return fits & F.rtrim(short).endswith("...") if ellipsis_only else fits

    t, w = F.col("__t"), F.col("__w")
    pairs = pairs.withColumn("__hit", (t == w) | cut(t, w) | cut(w, t))
    pairs = pairs.withColumn("__r", F.when(F.col("__hit"), 0.0).otherwise(_ratio(F.when(~F.col("__hit"), t), w)))
    good = pairs.filter(F.col("__hit") | (F.col("__r") >= least))
    order = F.struct(F.when(F.col("__hit"), 0).otherwise(1), -F.col("__r"), F.col("line_pos"))
    return good.groupBy("image_id", "target").agg(F.min_by(F.struct("line_pos", "text"), order).alias("b")).select("image_id", "target", "b.*")


# J8
def nearest_row(lines: DataFrame, threads: DataFrame) -> DataFrame:
    """Each line with the thread of its name (the last of several), else with the vertically nearest one (the first of several).

    ``lines``: image_id, line_pos, text, y; ``threads``: image_id, thread_pos, name, thread_y."""
    pairs = lines.join(threads, "image_id", "left")
    same = F.coalesce(F.col("name") == F.col("text"), F.lit(False))
    order = F.struct(F.when(same, 0).otherwise(1), F.when(same, 0).otherwise(F.abs(F.col("y") - F.col("thread_y"))), F.when(same, -F.col("thread_pos")).otherwise(F.col("thread_pos")))
    return pairs.groupBy(*[f"`{c}`" for c in lines.columns]).agg(F.min_by(F.struct("thread_pos", "name", "thread_y"), order).alias("b")).select(*lines.columns, "b.*")


# L7
def pick_title(lines: DataFrame, bands: int = 2) -> DataFrame:
    """``(image_id, title)`` of header lines ``(image_id, band, pos, text, hint)``."""
    s, hint = T.utrim(F.coalesce("text", F.lit(""))), T.utrim(F.coalesce("hint", F.lit("")))
    n = F.char_length(s)
    cjk = F.char_length(F.regexp_replace(s, "[^\\x{4E00}-\\x{9FFF}]", ""))
    letters = F.char_length(F.regexp_replace(s, r"(?U)\P{L}", ""))
    at_least = lambda share, least: F.greatest(F.lit(least), F.floor(n * share))
    name_like = ((cjk >= at_least(0.82, 2)) & (n <= 40)) | ((cjk == 0) & (letters >= at_least(0.75, 3)) & n.between(3, 56))
    hits = titles_match(T.normalize_title(s), T.normalize_title(hint))
    clean = T.plausible_name(s, "title") & (F.col("band") < bands)
    place = F.struct("band", "pos")
    rows = lines.select("image_id", "band", "pos", s.alias("s"), (hint != "").alias("hinted"), hits.alias("hits"), clean.alias("clean"), n.alias("n"), name_like.alias("name_like")).filter("s != ''")
    found = rows.groupBy("image_id").agg(
        F.bool_or("hinted").alias("hinted"),
        F.min_by(F.when(F.col("hits"), F.col("s")), F.when(F.col("hits"), place)).alias("hit"),
        F.min_by(F.struct("s", "name_like"), F.when(F.col("clean") & F.col("n").between(2, 56), F.struct("n", "band", "pos"))).alias("short"),
        F.min_by("s", F.when(F.col("clean"), place)).alias("first"),
    )
    fallback = F.when(F.col("short.name_like"), F.col("short.s"))
    return found.select("image_id", F.coalesce(F.when(F.col("hinted"), F.coalesce("hit", fallback)).otherwise(F.col("first")), F.lit("")).alias("title"))
