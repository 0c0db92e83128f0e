"""String columns: types, calls, media, tokens, names, badges and lines. All of them stay in the JVM but for NFKC and casefold."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from confab.schemas import CLEAN_TYPES, STORED_TYPES

# Synonyms of message types.
TYPE_SYNONYMS = {
    "link_card": ["link", "card", "share", "mini_program", "miniprogram"],
    "image": ["img", "photo", "sticker", "emoji"],
    "system": ["notice", "recall", "join", "leave", "date"],
    "call": ["voip", "phone_call", "voice_call", "video_call", "call_record", "audio_call"],
    "video": ["movie", "short_video", "clip"],
    "voice": ["voice_message", "audio_message", "audio"],
    "unsupported": ["file", "document", "unknown"],
}
# Lines by which the application shows calls.
CALL_WORDS_EN = ["Canceled", "Cancelled", "Declined", "Missed", "Busy", "No Answer", "Ended", "Calling", "Ringing"]
CALL_WORDS_CN = ["已取消", "未接听", "通话已取消", "对方已取消", "忙线", "无应答", "已拒绝", "已挂断", "语音通话", "视频通话"]
CALL_MARK, VOICE_MARK, VIDEO_MARK, CALL_LENGTH = "[通话]", "[语音]", "[视频]", "通话时长"
# Emoji ranges that labels drop.
EMOJI = "[\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F1E0}-\\x{1F1FF}\\x{1F900}-\\x{1F9FF}\\x{1FA00}-\\x{1FAFF}\\x{2600}-\\x{26FF}\\x{2700}-\\x{27BF}\\x{FE0F}\\x{200D}\\x{200C}]+"
PICTOGRAPH = "[\\x{200C}\\x{200D}\\x{FE00}-\\x{FE0F}\\x{1F1E6}-\\x{1F1FF}\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}]"
# Chat kinds and their other names.
CHAT_KINDS = {"groups": "group", "private_chat": "private", "private_chats": "private", "direct": "private", "dm": "private", "dms": "private", "all_chats": "all"}


def utrim(c: Column) -> Column:
    """Trims Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return utrim(F.regexp_replace(c, r"(?U)\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(utrim(c) != "", c)


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(str.casefold, na_action="ignore")


def _ascii(c: Column) -> Column:
    return F.char_length(c) == F.octet_length(c)


def nfkc(c: Column) -> Column:
    """Unicode normalisation form KC, for which Spark has no function; only texts beyond ASCII reach Python."""
    return F.when(_ascii(c), c).otherwise(_nfkc(F.when(~_ascii(c), c)))


def casefold(c: Column) -> Column:
    """Case folding; only texts beyond ASCII reach Python."""
    return F.when(_ascii(c), F.lower(c)).otherwise(_casefold(F.when(~_ascii(c), c)))


# X1, X2
def coerce_type(c: Column) -> Column:
    return F.when(c.isin(STORED_TYPES), c).otherwise("unsupported")


def normalize_type(c: Column) -> Column:
    t = F.lower(utrim(c))
    pairs = [F.lit(x) for kind, names in TYPE_SYNONYMS.items() for n in names for x in (n, kind)]
    return F.when(t.isin(CLEAN_TYPES), t).otherwise(F.coalesce(F.element_at(F.create_map(*pairs), t), F.lit("other")))


# X4, X5
def is_call_line(content: Column) -> Column:
    c = utrim(content)
    short = (F.char_length(c) <= 48) & (F.lower(c).isin([w.lower() for w in CALL_WORDS_EN]) | c.isin(CALL_WORDS_CN) | (c.startswith(CALL_LENGTH) & (F.char_length(c) < 28)))
    return (c != "") & (c.startswith(CALL_MARK) | short)


def refined_call(type_: Column, content: Column) -> tuple[Column, Column]:
    """Type and content of a message after call lines have been marked as such."""
    hit = type_.isin("text", "call") & is_call_line(content)
    c = utrim(content)
    return F.when(hit, "call").otherwise(type_), F.when(hit & ~c.startswith(CALL_MARK), F.concat(F.lit(CALL_MARK + " "), c)).otherwise(content)


def media_type(type_: Column, content: Column) -> Column:
    loose, c = type_.isin("unsupported", "other", "text"), utrim(content)
    return F.when(loose & c.startswith(VIDEO_MARK), "video").when(loose & c.startswith(VOICE_MARK), "voice").otherwise(type_)


# X6
def tokenize(c: Column) -> Column:
    """Latin words of two characters and more, and all 1- to 3-grams of runs of CJK characters, in order, with repeats."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9_]+|[\\x{4E00}-\\x{9FFF}]+)"), F.lit(1))

    def grams(run: Column) -> Column:
        n = F.char_length(run)
        of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
        return F.when(run.rlike("^[a-z0-9_]"), F.when(n >= 2, F.array(run)).otherwise(F.array().cast("array<string>"))).otherwise(F.concat(of(1), of(2), of(3)))

    return F.flatten(F.transform(runs, grams))


# X7
def safe_file_key(c: Column, fallback: str = "chat") -> Column:
    clean = F.regexp_replace(utrim(F.coalesce(c, F.lit(""))), r'[\\/:*?"<>|\x00-\x1f]', "_")
    clean = F.regexp_replace(clean, r"(?U)[.\s]+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback))


# X9 - X13
def one_ellipsis(c: Column) -> Column:
    return F.regexp_replace(c, "[…⋯]", "...")


def chat_label(c: Column) -> Column:
    return squeeze(F.regexp_replace(one_ellipsis(nfkc(F.coalesce(c, F.lit("")))), EMOJI, ""))


def label_with_emoji(c: Column) -> Column:
    return squeeze(one_ellipsis(nfkc(F.coalesce(c, F.lit("")))))


def without_pictographs(c: Column) -> Column:
    return utrim(F.regexp_replace(c, PICTOGRAPH, ""))


def compact_label(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, "[ \\x{3000}]", ""), "·・", "--")


def identity_key(label: Column) -> Column:
    return casefold(F.regexp_replace(label, r"[\p{P}\p{S}\p{Z}]", ""))


def chat_key(c: Column) -> Column:
    return F.lower(squeeze(F.coalesce(c, F.lit(""))))


def normalize_title(c: Column) -> Column:
    t = F.regexp_replace(utrim(F.coalesce(c, F.lit(""))), r"[（(]\d+[）)]$", "")
    t = F.regexp_replace(t, "^[ \\t、，。：；“”‘’]+|[ \\t、，。：；“”‘’]+$", "")
    return F.regexp_replace(t, r"(?U)[\s\-_–—·]+", "")


def cjk_core(c: Column) -> Column:
    return F.regexp_replace(c, "[^\\x{4E00}-\\x{9FFF}A-Za-z0-9]", "")


# X14, X18
def badge_cap(c: Column, most: int = 200) -> Column:
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")
    return F.when(digits == "", 1).otherwise(F.least(F.greatest(F.coalesce(digits.try_cast("int"), F.lit(most)), F.lit(1)), F.lit(most)))


def chat_kind(name: str | None) -> str:
    kind = (name or "group").strip().lower()
    kind = CHAT_KINDS.get(kind, kind)
    if kind not in ("group", "private", "all"):
        raise ValueError(f"chat kind must be group, private or all, not {kind!r}")
    return kind


# X15
def clean_ocr_name(c: Column) -> Column:
    """A chat's name without the first letter of its picture, punctuation at its end and the preview that was merged into it."""
    s = utrim(F.coalesce(c, F.lit("")))
    for pattern, by in (
        (r"(?<=[A-Za-z0-9])〇(?=[A-Za-z0-9])", "O"),
        ("^[A-Z]\\s+(?=[\\x{4E00}-\\x{9FFF}])", ""),
        (r"^[A-Z](?=[^\x00-\x7f])", ""),
        (r"\s+[A-Z]$", ""),
        ("[、，。：；]+$", ""),
    ):
        s = F.regexp_replace(s, pattern, by)
    return strip_preview(utrim(s))


# Words that begin a preview, units of time that passed, names of weekdays, their days, numerals, and words left at a name's end.
PREVIEW_DAYS = ["昨天", "今天", "前天", "刚刚"]
AGO = {"分": "钟", "小": "时"}
WEEK, WEEKDAYS, NUMERALS = ["周", "星期"], "一二三四五六日天", "一二三四五六七八九十"
LEFT_OVER = ["and", "or", "the"]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _without_last(s: Column, gone: Callable[[Column], Column]) -> Column:
    """The name without its last word, where ``gone`` holds for that and other words are before it."""
    cut = lambda word: F.when((word != s) & gone(word), utrim(F.substring(s, F.lit(1), F.char_length(s) - F.char_length(word)))).otherwise(s)
    return _let(F.element_at(F.split(s, r"(?U)\s+"), -1), cut)


def _shape(word: Column) -> Column:
    """A word with each digit as 0 and each Latin letter as a."""
    return F.regexp_replace(F.regexp_replace(word, r"(?U)\d", "0"), "[a-zA-Z]", "a")


def _counts(word: Column, digits: int, letters: int) -> Column:
    """Up to so many digits, and then up to so many letters."""
    numbers = lambda shape: F.length(F.rtrim(shape, F.lit("a")))
    return _let(_shape(word), lambda x: (F.translate(F.rtrim(x, F.lit("a")), "0", "") == "") & numbers(x).between(1, digits) & (F.length(x) - numbers(x) <= letters))


def _weekday(word: Column) -> Column:
    """What stands behind a weekday at a word's start; null if none does."""
    after = lambda n: F.when((F.char_length(word) > n) & F.lit(WEEKDAYS).contains(F.substring(word, n + 1, 1)), F.substring(word, F.lit(n + 2), F.char_length(word)))
    return F.coalesce(*[F.when(word.startswith(week), after(len(week))) for week in WEEK])


def _from_day_word(s: Column) -> Column:
    begins = F.coalesce(*(F.when(F.instr(s, day) > 1, F.instr(s, day)) for day in PREVIEW_DAYS), F.char_length(s) + 1)
    return utrim(F.substring(s, F.lit(1), begins - 1))


def _from_time_ago(s: Column) -> Column:
    forms = "|".join(rf"{unit}\s*{rest}?\s*前" for unit, rest in AGO.items())
    cut = lambda ago: F.when(ago > 0, utrim(F.substring(s, F.lit(1), F.greatest(F.char_length(s) - ago - 8, F.lit(0))))).otherwise(s)
    return _let(F.char_length(F.regexp_extract(s, f"(?U)({forms})$", 1)), cut)


def _spaced_weekday(s: Column) -> Column:
    day = lambda behind: behind.isNotNull() & ((F.translate(behind, "0" + NUMERALS, "") == "") | F.translate(behind, "：", ":").isin(":0", ":00"))
    return _without_last(s, lambda word: _let(_shape(_weekday(word)), day))


def _glued_weekday(s: Column) -> Column:
    for week in WEEK:
        n = len(week) + 1
        end = F.substring(s, -n, n)
        s = F.when((F.char_length(s) >= n) & end.startswith(week) & (_weekday(end) == ""), utrim(F.substring(s, F.lit(1), F.char_length(s) - n))).otherwise(s)
    return s


def _date(word: Column) -> Column:
    parts = lambda x: (F.size(x) == 3) & (x[0] == "0000") & x[1].isin("0", "00") & x[2].isin("0", "00")
    marks = [a + b + c for a in "-/年" for b in "-/月" for c in ("", "日", "号")]
    return _let(_shape(word), lambda x: F.translate(x, "0", "").isin(marks) & _let(F.split(F.rtrim(x, F.lit("日号")), "[-/年月]"), parts))


def _counters(s: Column) -> Column:
    words = F.reverse(F.split(s, r"(?U)\s+"))
    drop = lambda a, w: F.when(a["on"] & _counts(w, 3, 3), F.struct(_without_last(a["s"], lambda _: F.lit(True)).alias("s"), F.lit(True).alias("on"))).otherwise(F.struct(a["s"].alias("s"), F.lit(False).alias("on")))
    return F.aggregate(words, F.struct(s.alias("s"), F.lit(True).alias("on")), drop, lambda a: a["s"])


def _and_number(s: Column) -> Column:
    without = lambda before: _let(_without_last(before, lambda w: w.isin("and", "And")), lambda cut: F.when((before != s) & (cut != before), cut).otherwise(s))
    return _let(_without_last(s, lambda w: _counts(w, 4, 1)), without)


def _doubled_plural(s: Column) -> Column:
    return F.when(F.lower(s).endswith("sse") & (_shape(F.substring(s, -5, 2)) == "aa") & (F.char_length(s) >= 5), F.substring(s, F.lit(1), F.char_length(s) - 2)).otherwise(s)


#: The kinds of tails, in the order in which each is cut once (counters as often as they come).
TAILS = [
    _from_day_word, _from_time_ago, _spaced_weekday, _glued_weekday, lambda s: _without_last(s, lambda w: _shape(w).isin("0:00", "00:00")), lambda s: _without_last(s, _date),
    lambda s: F.rtrim(s, F.lit(" ·…")), _counters, _and_number, lambda s: _without_last(s, lambda w: F.lower(w).isin(LEFT_OVER)), _doubled_plural,
]


def strip_preview(s: Column) -> Column:
    """A name without the preview that was merged into its end: all from a word of a day on, minutes or hours ago with up to eight characters before, a weekday with its
    numerals or hour, a weekday without a space, a clock time, a date, dots, counters, ``and`` with a number, a word left over, a plural's doubled ending."""
    s = utrim(s)
    for tail in TAILS:
        s = _let(s, tail)
    return s


# X16
def render_line(time: Column, sender: Column, type_: Column, content: Column) -> Column:
    tag = F.when(F.coalesce(type_, F.lit("text")) != "text", F.concat(F.lit(" ["), type_, F.lit("]"))).otherwise("")
    return F.concat(
        F.lit("- "), F.coalesce(blank_to_null(time), F.lit("时间未知")), F.lit(" | "), F.coalesce(blank_to_null(sender), F.when(type_ == "system", "System"), F.lit("?")), tag,
        F.lit(": "), F.coalesce(blank_to_null(content), F.lit("(空内容)")),
    )


def transcript_line(time: Column, sender: Column, type_: Column, content: Column, markdown: bool) -> Column:
    some = F.coalesce(time, F.lit("")) != ""
    at = F.when(some, F.concat(F.lit("["), time, F.lit("] "))).otherwise("")
    kind = F.coalesce(type_, F.lit("text"))
    star, bold = ("*", "**") if markdown else ("", "")
    tag = F.when(kind != "text", F.concat(F.lit(f" {star}["), kind, F.lit(f"]{star}"))).otherwise("")
    return F.concat(F.lit("- " if markdown else ""), at, F.lit(bold), F.coalesce(sender, F.lit("?")), F.lit(bold), tag, F.lit(": "), F.coalesce(content, F.lit("")))


# X17
def normalize_ocr_text(c: Column) -> Column:
    return squeeze(F.regexp_replace(one_ellipsis(nfkc(F.coalesce(c, F.lit("")))), r"^[\\ ]+|[\\ ]+$", ""))


# X19
@F.pandas_udf(StringType())
def _cut_repeats(s: pd.Series) -> pd.Series:
    def cut(text: str) -> str:
        n, end = len(text), len(text) - 1
        for size in range(2, n // 10 + 1):
            if text[end] != text[end - size] or not text.endswith(text[-size:] * 10):
                continue
            unit, copies = text[-size:], 10
            while text[max(0, n - size * (copies + 1)) : n - size * copies] == unit:
                copies += 1
            return text[: n - size * (copies - 1)]
        return text

    return s.map(cut, na_action="ignore")


def trim_repetition(c: Column) -> Column:
    """Cuts ten and more copies of one unit at the end of a long text to one; only long texts reach Python."""
    return F.when(F.char_length(c) >= 8000, _cut_repeats(F.when(F.char_length(c) >= 8000, c))).otherwise(c)


# F7, F8, F9
# Forms of a line that is only a time, of a separator between messages, and the characters of numbers and badges.
TIME_ONLY = r"^(?:\d{1,2}:\d{2}(?::\d{2})?|\d{1,2}月\d{1,2}日(?:\s+\d{1,2}:\d{2})?|\d{4}[-/]\d{1,2}[-/]\d{1,2}(?:\s+\d{1,2}:\d{2})?)$"
_CLOCK = r"\d{1,2}[:：]\d{2}(?:\s*(?:am|pm))?"
SEPARATOR = rf"(?iU)^(?:(?:昨天|前天|今天|星期[一二三四五六日天]|周[一二三四五六日天]|yesterday|today|\d{{1,2}}月\d{{1,2}}日|\d{{4}}年\d{{1,2}}月\d{{1,2}}日)?\s*)?{_CLOCK}$"
JUNK = "[+0123456789⑦⑧⑨⑩①②③④⑤⑥⑪⑫⑬⑭⑮ \\t·.。:：]"


def is_time_only(content: Column) -> Column:
    c = utrim(F.coalesce(content, F.lit("")))
    return (c == "") | ((F.char_length(c) <= 48) & c.rlike("(?U)" + TIME_ONLY))


def is_separator(c: Column) -> Column:
    return utrim(F.coalesce(c, F.lit(""))).rlike(SEPARATOR)


def junk_share(c: Column) -> Column:
    n = F.char_length(c)
    return F.when(n > 0, (n - F.char_length(F.regexp_replace(c, JUNK, ""))) / n).otherwise(1.0)


def plausible_name(c: Column, rule: str = "sidebar") -> Column:
    s = utrim(F.coalesce(c, F.lit("")))
    if rule == "sidebar":
        return (F.char_length(c) >= 2) & ~F.coalesce(c, F.lit("")).rlike(r"(?U)^\d+$")
    if rule == "ocr":
        return (F.char_length(s) >= 2) & ~s.rlike("^[A-Za-z]{2}$")
    if rule == "header":
        return (F.char_length(s) >= 2) & ~s.rlike(r"(?U)^\d+$") & (junk_share(s) < 0.5)
    digits, letters = F.char_length(F.regexp_replace(s, r"(?U)\D", "")), F.char_length(F.regexp_replace(s, "[^\\x{4E00}-\\x{9FFF}A-Za-z]", ""))
    counter = s.rlike(r"^[（(]\d{1,3}[）)]") & (digits >= 3) & (letters <= 3)
    return (F.char_length(s) > 1) & (junk_share(s) < 0.5) & ~counter
