"""Ordered folds: operators that compare a row with rows that were kept before it, which no window can say.

``fold`` deals rows by key and sorts them within partitions; a Python step then streams through each key's rows and
holds only the last few kept ones, so a key of any size passes in bounded memory. A row is emitted when it leaves that
window, since later rows may still fill in its time.
"""

from __future__ import annotations

import difflib
import hashlib
import pickle
import re
import uuid
from collections import Counter, deque
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confab.streaming.scratch import remove, scratch

#: A step gets the kept rows, oldest first, and a new row; it returns whether the new row is kept. It may set a kept row's time.
Step = Callable[[list[dict], dict], bool]
LOOKBACK = 5


def _fill_time(kept: dict, row: dict) -> None:
    if row["time"] and not kept["time"]:
        kept["time"] = row["time"]


def lookback_step(fields: tuple[str, ...] = ("sender", "content"), fill: bool = True) -> Step:
    """D4, D5: drops a row that agrees in ``fields`` with a kept one; the first such kept row takes its time."""

    def step(kept: list[dict], row: dict) -> bool:
        for k in kept:
            if all((k[f] or "") == (row[f] or "") for f in fields):
                if fill:
                    _fill_time(k, row)
                return False
        return True

    return step


def similar_step(ratio: float = 0.88, min_len: int = 30) -> Step:
    """D6: drops a long text that is like a kept one of the same sender and type. Exact upper bounds of the ratio come first."""

    def plain(x: str | None) -> str:
        return re.sub(r"\s+", " ", (x or "").strip())

    # of each kept text, by its content: the plain form, its characters and a matcher that knows it as the second text
    known: dict[str | None, tuple[str, Counter, difflib.SequenceMatcher | None]] = {}

    def of(x: str | None) -> tuple[str, Counter, difflib.SequenceMatcher | None]:
        if x not in known:
            text = plain(x)
            known[x] = (text, Counter(text), difflib.SequenceMatcher(None, "", text) if len(text) >= min_len else None)
        return known[x]

    def step(kept: list[dict], row: dict) -> bool:
        if row["type"] not in ("text", "other"):
            return True
        new = plain(row["content"])
        if len(new) < min_len:
            return True
        seen, chars = {k["content"] for k in kept}, None
        for x in [x for x in known if x not in seen]:
            del known[x]
        for k in kept:
            if k["sender"] != row["sender"] or k["type"] != row["type"]:
                continue
            old, old_chars, matcher = of(k["content"])
            if len(old) < min_len or 2 * min(len(new), len(old)) < ratio * (len(new) + len(old)):
                continue
            if new != old:  # of equal texts the ratio is 1, where no character is so frequent that difflib leaves it out
                chars = Counter(new) if chars is None else chars
                if 2.0 * (chars & old_chars).total() / (len(new) + len(old)) < ratio:
                    continue
            elif len(old) < 200:
                _fill_time(k, row)
                return False
            matcher.set_seq1(new)
            if matcher.ratio() >= ratio:
                _fill_time(k, row)
                return False
        return True

    return step


# Fixed value: how a voice message's duration is written.
_DURATION = re.compile(r"(?:\d{1,2}[:：]\d{2}(?::\d{2})?|\d{1,3}[\"'″′秒sS]?|\d+\s*秒)\Z")


def voice_step() -> Step:
    """D7: drops a line that only repeats the duration of the voice message before it."""

    def step(kept: list[dict], row: dict) -> bool:
        if not kept:
            return True
        last, new = kept[-1], (row["content"] or "").strip()
        voice = last["content"] or ""
        if last["sender"] != row["sender"] or last["type"] != "voice" or "[语音]" not in voice or row["type"] not in ("text", "unsupported", "other", "voice"):
            return True
        if len(new) > 16 or not _DURATION.match(new):
            return True
        short = re.sub(r"\s+", "", new)
        digits = re.sub(r"\D", "", new)
        return not (short in re.sub(r"\s+", "", voice) or digits and digits == re.sub(r"\D", "", voice))

    return step


class Window:
    """A step with the kept rows that it looks at."""

    def __init__(self, step: Step, size: int):
        self.step, self.size, self.kept = step, size, deque()

    def put(self, row: dict) -> list[dict]:
        """Rows that leave the window."""
        if not self.step(list(self.kept), row):
            return []
        self.kept.append(row)
        return [self.kept.popleft()] if len(self.kept) > self.size else []

    def end(self) -> list[dict]:
        out, self.kept = list(self.kept), deque()
        return out


def through(windows: list[Window], rows: list[dict], end: bool = False) -> list[dict]:
    """Rows that come out of a chain of windows when ``rows`` go in; with ``end``, the windows are emptied in order."""
    for w in windows:
        out = []
        for r in rows:
            out += w.put(r)
        rows = out + (w.end() if end else [])
    return rows


#: A key with more rows than this is cut into segments of about SEGMENT rows.
HOT, SEGMENT = 1_000_000, 200_000
Steps = list[tuple[Callable[[], Step], int]]


def fold(df: DataFrame, key: list[str], order: list[str], steps: Steps, hot: int | None = None, segment: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """``df`` without the rows that the steps drop, one after the other, among the rows of each key in order.

    The keys with more than ``hot`` rows are folded in segments at the same time (:func:`_fold_segments`); the result is that of one fold over all rows. Rows are counted in
    ``counted``, where that has all of them and is cheaper to read."""
    hot, segment = HOT if hot is None else hot, SEGMENT if segment is None else segment
    large = (df if counted is None else counted).groupBy(*key).agg(F.count("*").alias("__rows")).filter(F.col("__rows") > hot)
    total = large.agg(F.sum("__rows")).first()[0]
    if not total:
        return _fold_keys(df, key, steps, order)
    large = large.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)])
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key)])
    rest = _fold_keys(df.join(large, same, "left_anti"), key, steps, order)
    return rest.unionByName(_fold_segments(df.join(large, same, "left_semi"), key, order, steps, -(-total // segment)))


def _records(frame: pd.DataFrame) -> list[dict]:
    columns = []
    for name in frame.columns:
        values, null = frame[name].tolist(), frame[name].isna()
        columns.append([None if n else x for x, n in zip(values, null.tolist(), strict=True)] if null.any() else values)
    return [dict(zip(frame.columns, row, strict=True)) for row in zip(*columns, strict=True)]


def _fold_keys(df: DataFrame, key: list[str], steps: Steps, order: list[str]) -> DataFrame:
    columns = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, windows = None, []
        for frame in frames:
            out = []
            for row in _records(frame):
                at = tuple(row[k] for k in key)
                if at != current:
                    out += through(windows, [], end=True)
                    current, windows = at, [Window(make(), size) for make, size in steps]
                out += through(windows, [row])
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(through(windows, [], end=True), columns=columns)

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, df.schema)


def _fold_segments(df: DataFrame, key: list[str], order: list[str], steps: Steps, n: int) -> DataFrame:
    """The fold over ``n`` segments of the rows in order, all at the same time.

    What a segment needs of those before it is the kept rows in the windows at its start. These are guessed, as what the segment before leaves when it starts with empty windows:
    windows hold few rows, so what they hold at a segment's end rarely depends on what they held at its start. Then all segments are folded from the
    guesses, and those that started from another state than the segment before has left in the end are folded again, until none is left. The first segment is right, and
    one that starts from what a right one left is right, so the result is that of one fold over all rows. At worst, where every row decides on the last, there are as many rounds as segments.

    Segments, states and results are stored in the shared folder; a state is a row of a few messages, and travels to its segment by a shuffle."""
    spark, columns = df.sparkSession, df.columns
    base = f"{scratch(spark)}/confab-{uuid.uuid4().hex}"

    def stored(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{base}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{base}/{name}")

    # segments are numbered in the order of the rows
    rows = stored(df.repartitionByRange(n, *key, *order).withColumn("__segment", F.spark_partition_id()), "segments")
    last = rows.agg(F.max("__segment")).first()[0]
    kind = T.StructType([*rows.schema.fields, T.StructField("__state", T.BinaryType()), T.StructField("__mark", T.StringType())])

    def table(out: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({f.name: pd.Series([r.get(f.name) for r in out], dtype=object) for f in kind.fields})

    def run(emit: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            segment, current, windows = None, None, []

            def close() -> list[dict]:
                """What a segment leaves: the last one its rows, another one its state."""
                if segment is None:
                    return []
                if segment == last and emit:
                    return [r | {"__segment": segment} for r in through(windows, [], end=True)]
                held = [list(w.kept) for w in windows]
                return [{"__segment": segment, "__state": pickle.dumps((current, held)), "__mark": hashlib.sha256(repr((current, held)).encode()).hexdigest()}]

            for frame in frames:
                out = []
                for row in _records(frame):
                    if row["__segment"] != segment:
                        out += close()
                        segment, current, windows = row["__segment"], None, []
                    state = row.pop("__state")
                    if state is not None:
                        current, held = pickle.loads(state)
                        windows = [Window(make(), size) for make, size in steps]
                        for w, kept in zip(windows, held, strict=True):
                            w.kept = deque(kept)
                        continue
                    del row["__segment"], row["__mark"]
                    at = tuple(row[k] for k in key)
                    if at != current:
                        ended = through(windows, [], end=True)
                        out += [r | {"__segment": segment} for r in ended] if emit else []
                        current, windows = at, [Window(make(), size) for make, size in steps]
                    passed = through(windows, [row])
                    out += [r | {"__segment": segment} for r in passed] if emit else []
                yield table(out)
            yield table(close())

        return each

    def folded(some: DataFrame, states: DataFrame | None, name: str) -> DataFrame:
        fed = some.withColumns({"__state": F.lit(None).cast("binary"), "__mark": F.lit(None).cast("string")})
        if states is not None:
            before = states.select((F.col("__segment") + 1).alias("__segment"), "__state", "__mark")
            fed = fed.unionByName(before, allowMissingColumns=True)
        fed = fed.select(*[f.name for f in kind.fields])
        dealt = fed.repartition("__segment").sortWithinPartitions("__segment", F.col("__state").isNull(), *key, *order)
        return stored(dealt.mapInPandas(run(states is not None), kind), name)

    of_states = lambda out: out.filter("__state IS NOT NULL").select("__segment", "__state", "__mark")
    states = of_states(folded(rows, None, "guesses")).filter(F.col("__segment") < last)
    out, again, turn = None, rows, 0
    while True:
        turn += 1
        new = folded(again, states.join(again.select(F.col("__segment") - 1).distinct().toDF("__segment"), "__segment", "left_semi") if out is not None else states, f"round{turn}")
        done = new if out is None else out.join(new.select("__segment").distinct(), "__segment", "left_anti").unionByName(new)
        left = of_states(new)
        changed = left.alias("n").join(states.alias("o"), "__segment").filter("n.__mark != o.__mark").select((F.col("__segment") + 1).alias("__segment"))
        changed = stored(changed.distinct(), f"changed{turn}")
        if changed.isEmpty():
            break
        states = stored(states.join(left.select("__segment"), "__segment", "left_anti").unionByName(left), f"states{turn}")
        out, again = stored(done, f"out{turn}"), rows.join(changed, "__segment", "left_semi")
    final = stored(done.filter("__state IS NULL").select(*columns), "folded")
    remove(spark, *[f"{base}/{x}" for x in ("segments", "guesses", *[f"{y}{t}" for t in range(1, turn + 1) for y in ("round", "changed", "states", "out")])])
    return final
