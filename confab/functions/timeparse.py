"""Chat times, which are free text, as naive timestamps relative to a given now; and windows over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confab.functions.text import utrim

# Names of weekdays; the first that occurs in a text, in this order, counts.
WEEKDAYS = [
    (0, ["星期一", "周一", "monday", "mon"]),
    (1, ["星期二", "周二", "tuesday", "tue", "tues"]),
    (2, ["星期三", "周三", "wednesday", "wed"]),
    (3, ["星期四", "周四", "thursday", "thu", "thur", "thurs"]),
    (4, ["星期五", "周五", "friday", "fri"]),
    (5, ["星期六", "周六", "saturday", "sat"]),
    (6, ["星期日", "星期天", "周日", "周天", "sunday", "sun"]),
]
# Marks of the half of the day.
PM, AM = ["pm", "下午", "晚上", "晚", "中午"], ["am", "上午", "早上", "凌晨", "清晨"]


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _folded(raw: Column) -> Column:
    text = F.translate(utrim(F.coalesce(raw, F.lit(""))), "：/.０１２３４５６７８９", ":--0123456789")
    return F.lower(F.regexp_replace(text, r"(?U)\s+", " "))


def _shown(low: Column) -> tuple[Column, Column]:
    """Hour and minute as they stand."""
    hour, minute = (F.nullif(F.regexp_extract(low, r"(\d{1,2}):(\d{2})", i), F.lit("")).try_cast("int") for i in (1, 2))
    return hour, minute


def _hour(low: Column, hour: Column) -> Column:
    pm, am = _any(low, PM), _any(low, AM)
    return F.when(pm & (hour < 12), hour + 12).when(~pm & am & (hour == 12), 0).otherwise(hour)


def _minutes(hour: Column, minute: Column) -> Column:
    return F.when((hour <= 23) & (minute <= 59), hour * 60 + minute)


# Forms of dates with and without a year.
_FULL, _SHORT = r"(\d{4})[-年](\d{1,2})[-月](\d{1,2})", r"(?<!\d)(\d{1,2})[-月](\d{1,2})"


def _weekday(low: Column) -> Column:
    weekday = F.lit(None).cast("int")
    for n, words in reversed(WEEKDAYS):
        weekday = F.when(_any(low, words), n).otherwise(weekday)
    return weekday


def _moment(low: Column, minutes: Column, weekday: Column, now: Column) -> Column:
    now = now.cast("timestamp_ntz")

    def at(day: Column) -> Column:
        return F.timestamp_add("MINUTE", minutes, day.cast("timestamp_ntz"))

    def dated(y: Column, m: Column, d: Column) -> Column:
        return at(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date"))

    today = F.to_date(now)
    latest = now + F.expr("interval 5 minutes")
    year, month, day = (F.regexp_extract(low, _FULL, i) for i in (1, 2, 3))
    m2, d2 = (F.regexp_extract(low, _SHORT, i) for i in (1, 2))
    this = dated(F.year(now).cast("string"), m2, d2)
    near = F.when(this > now + F.expr("interval 1 day"), dated((F.year(now) - 1).cast("string"), m2, d2)).otherwise(this)
    back = F.pmod(F.weekday(today) - weekday, F.lit(7))
    on_day = at(F.date_sub(today, back))
    on_day = F.when(on_day > latest, at(F.date_sub(today, back + 7))).otherwise(on_day)
    plain = F.when(at(today) > latest, at(F.date_sub(today, 1))).otherwise(at(today))
    found = (
        F.when(low.rlike(_FULL), dated(year, month, day))
        .when(low.rlike(_SHORT), near)
        .when(_any(low, ["昨天", "yesterday"]), at(F.date_sub(today, 1)))
        .when(_any(low, ["今天", "today"]), at(today))
        .when(weekday.isNotNull(), on_day)
        .otherwise(plain)
    )
    return F.when(minutes.isNotNull(), found)


def parse_message_time(raw: Column, now: Column) -> Column:
    """TIMESTAMP_NTZ of a chat's time text; null where there is no clock or no such date. For whole tables :func:`with_message_time` is much faster."""
    low = _folded(raw)
    hour, minute = _shown(low)
    return _moment(low, _minutes(_hour(low, hour), minute), _weekday(low), now)


def with_message_time(rows: DataFrame, raw: Column, now: Column, name: str = "event_time") -> DataFrame:
    """Adds :func:`parse_message_time` in steps. A step's results are columns, so that the many places that use the folded text or the clock do not each make it again."""
    low, hour, minute, minutes = F.col("__low"), F.col("__hour"), F.col("__minute"), F.col("__minutes")
    rows = rows.withColumn("__low", _folded(raw))
    rows = rows.withColumns(dict(zip(("__hour", "__minute"), _shown(low), strict=True)))
    rows = rows.withColumn("__minutes", _minutes(_hour(low, hour), minute))
    rows = rows.withColumn("__weekday", F.when(minutes.isNotNull() & ~low.rlike(_FULL), _weekday(low)))
    return rows.withColumn(name, _moment(low, minutes, F.col("__weekday"), now)).drop("__low", "__hour", "__minute", "__minutes", "__weekday")


# W2
def with_effective_time(messages: DataFrame, now: Column, sequence: list[str], order: list[str]) -> DataFrame:
    """Adds ``event_time`` (parsed) and ``effective_time`` (that of the last parsed row so far in the sequence)."""
    w = W.partitionBy(*sequence).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    parsed = with_message_time(messages, F.col("time"), now)
    return parsed.withColumn("effective_time", F.last("event_time", ignorenulls=True).over(w))


def cutoff(hours: int, now: Column) -> Column:
    return F.timestamp_add("HOUR", F.lit(-hours), now.cast("timestamp_ntz"))


# F11
def recent_window(messages: DataFrame, hours: int, now: Column) -> DataFrame:
    """Rows whose effective time is unknown or not older than so many hours; all rows if hours are 0 or less."""
    if hours <= 0:
        return messages
    return messages.filter(F.col("effective_time").isNull() | (F.col("effective_time") >= cutoff(hours, now)))


# W5
def drop_chunks_before_cutoff(messages: DataFrame, hours: int, now: Column, chat: list[str], chunk: str = "chunk_index") -> DataFrame:
    """Leaves out chunks that are older than the newest chunk which reaches back beyond the cutoff, and rows without a chat or chunk. Reads ``messages`` twice."""
    if hours <= 0:
        return messages
    newest = messages.groupBy(*chat).agg(F.max(F.when(F.col("effective_time") < cutoff(hours, now), F.col(chunk))).alias("__newest"))
    return messages.filter(F.col(chunk).isNotNull()).join(newest, chat).filter(F.col("__newest").isNull() | (F.col(chunk) >= F.col("__newest"))).select(*messages.columns)
