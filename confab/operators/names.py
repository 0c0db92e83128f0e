"""Joining noisy, cut-off chat names to a list of configured names."""

from __future__ import annotations

import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confab.functions import text as T
from confab.operators.order import running
from confab.streaming.scratch import remove, scratch

CUT_LEN, REVERSE_LEN, LOOSE_LEN = 4, 3, 3
#: Matching pairs of distinct names up to this many are broadcast to the rows.
BROADCAST_PAIRS = 10_000
#: A core that is a word and a number.
NUMBERED = r"^([A-Za-z][A-Za-z0-9]*?)(\d+)$"


def _uncut(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[\s.。．…⋯]+$", "")


def with_keys(rows: DataFrame, name: str, prefix: str) -> DataFrame:
    """Adds all forms of a name under which names are compared, once per row."""
    label = T.chat_label(F.col(name))
    rows = rows.withColumns({f"{prefix}label": label, f"{prefix}strict": T.casefold(T.utrim(F.coalesce(F.col(name), F.lit("")))), f"{prefix}full": T.label_with_emoji(F.col(name))})
    lab = F.col(f"{prefix}label")
    rows = rows.withColumns({
        f"{prefix}compact": T.compact_label(lab),
        f"{prefix}stem": _uncut(lab),
        f"{prefix}core": T.without_pictographs(F.coalesce(F.col(name), F.lit(""))),
        f"{prefix}title": T.normalize_title(F.col(name)),
    })
    rows = rows.withColumns({
        f"{prefix}stem_compact": T.compact_label(F.col(f"{prefix}stem")),
        f"{prefix}title_core": T.cjk_core(F.col(f"{prefix}title")),
        f"{prefix}full_low": F.lower(F.col(f"{prefix}full")),
    })
    align = F.regexp_replace(F.translate(F.col(f"{prefix}compact"), "-_", ""), r"[.。．…⋯]+$", "")
    return rows.withColumns({
        f"{prefix}identity": T.identity_key(lab),
        f"{prefix}stem_identity": T.identity_key(F.col(f"{prefix}stem")),
        f"{prefix}core_fold": T.casefold(F.col(f"{prefix}core")),
        f"{prefix}full_fold": T.casefold(F.regexp_replace(F.col(f"{prefix}full"), r"(?:\.\.\.\s*)+$", "")),
        f"{prefix}align": align,
    })


def _proper_prefix(short: Column, long: Column, least: int) -> Column:
    return (F.char_length(short) >= least) & (F.char_length(short) < F.char_length(long)) & long.startswith(short)


# J1
def names_match(v: str = "v_", c: str = "c_") -> Column:
    """A visible name and a configured one mean the same chat; over the columns of :func:`with_keys`."""
    vl, cl, vc, cc = F.col(f"{v}label"), F.col(f"{c}label"), F.col(f"{v}compact"), F.col(f"{c}compact")
    stem = F.col(f"{v}stem")
    return (vl != "") & (cl != "") & (
        (vl == cl) | (vc == cc) | ((F.char_length(cc) >= 2) & vc.startswith(cc)) | _proper_prefix(vc, cc, REVERSE_LEN)
        | _proper_prefix(stem, cl, CUT_LEN) | ((F.char_length(stem) >= CUT_LEN) & (_proper_prefix(F.col(f"{v}stem_compact"), cc, CUT_LEN) | _proper_prefix(F.col(f"{v}stem_identity"), F.col(f"{c}identity"), CUT_LEN)))
    )


# J2
def names_match_strict(v: str = "v_", c: str = "c_") -> Column:
    vs, cs, core = F.col(f"{v}strict"), F.col(f"{c}strict"), F.col(f"{c}core_fold")
    seen = F.col(f"{v}full_fold")
    cut = lambda full: _proper_prefix(seen, full, CUT_LEN)
    return (vs != "") & (cs != "") & ((vs == cs) | ((core != "") & (vs == core)) | cut(F.col(f"{c}full_low")) | ((core != "") & cut(core)))


# J3
def titles_match(a: Column, b: Column, a_core: Column | None = None, b_core: Column | None = None) -> Column:
    """Two normalised titles are alike: equal, one within the other, or with most characters in common, but not with different last parts. The
    cores may be given, where they are columns already."""
    x, y = F.lower(a), F.lower(b)
    short_first = F.char_length(x) <= F.char_length(y)
    short, long = F.when(short_first, x).otherwise(y), F.when(short_first, y).otherwise(x)
    within = (F.char_length(short) >= LOOSE_LEN) & (F.char_length(short) < F.char_length(long)) & F.contains(long, short)
    p, q = (T.cjk_core(a) if a_core is None else a_core), (T.cjk_core(b) if b_core is None else b_core)
    p_first = F.char_length(p) <= F.char_length(q)
    small, large = F.when(p_first, p).otherwise(q), F.when(p_first, q).otherwise(p)
    common = F.size(F.filter(F.split(small, ""), lambda ch: F.contains(large, ch)))
    stem = lambda t: F.lower(F.regexp_extract(t, NUMBERED, 1))
    clash = p.rlike(NUMBERED) & q.rlike(NUMBERED) & (stem(p) == stem(q)) & (F.regexp_extract(p, NUMBERED, 2) != F.regexp_extract(q, NUMBERED, 2))
    alike = (F.char_length(small) >= 2) & (common >= F.greatest(F.lit(3), F.ceil(F.char_length(small) * 0.72))) & ~clash
    return (a != "") & (b != "") & ((x == y) | within | alike)


# J4
def aligned(a: Column, b: Column) -> Column:
    a_first = F.char_length(a) <= F.char_length(b)
    short, long = F.when(a_first, a).otherwise(b), F.when(a_first, b).otherwise(a)
    return (a != "") & (b != "") & ((a == b) | ((F.char_length(short) >= 3) & long.startswith(short)))


def combined_match(v: str = "v_", c: str = "c_") -> Column:
    loose = names_match(v, c) | names_match_strict(v, c) | titles_match(F.col(f"{v}title"), F.col(f"{c}title"), F.col(f"{v}title_core"), F.col(f"{c}title_core"))
    return loose & (names_match_strict(v, c) | aligned(F.col(f"{v}align"), F.col(f"{c}align")))


# --- candidates -----------------------------------------------------------------------------------------------------
#
# Every rule is a union of equality joins whose pairs match, or nearly so: a form that is the start of another is found by joining it, whole, with the starts of the
# other, and not by joining short keys and judging all that share one. Work grows with the names and with the matches.

def _none() -> Column:
    return F.array().cast("array<string>")


def _whole(form: str, tag: str, least: int = 1, when: Column | None = None) -> Column:
    """The form itself as a key, if it is as long as ``least``."""
    c = F.col(form)
    return F.when((F.char_length(c) >= least) & (F.lit(True) if when is None else when), F.array(F.concat(F.lit(tag), c))).otherwise(_none())


def _starts(form: str, tag: str, least: int, proper: bool = True, when: Column | None = None) -> Column:
    """All starts of a form from ``least`` characters on, without the form itself if they are to be proper ones."""
    c = F.col(form)
    last = F.char_length(c) - int(proper)
    cuts = F.transform(F.sequence(F.lit(least), F.greatest(last, F.lit(least))), lambda k: F.concat(F.lit(tag), F.substring(c, F.lit(1), k)))
    return F.when((last >= least) & (F.lit(True) if when is None else when), cuts).otherwise(_none())


#: Keys of a seen name and of a configured one.
Keys = tuple[Column, Column]


def _plain_keys() -> list[Keys]:
    long_stem, n = F.char_length("v_stem") >= CUT_LEN, CUT_LEN
    return [
        (_whole("v_label", "l"), _whole("c_label", "l")),
        (_whole("v_compact", "e"), _whole("c_compact", "e")),
        (_starts("v_compact", "a", 2, proper=False), _whole("c_compact", "a", 2)),
        (_whole("v_compact", "b", REVERSE_LEN), _starts("c_compact", "b", REVERSE_LEN)),
        (_whole("v_stem", "s", n), _starts("c_label", "s", n)),
        (_whole("v_stem_compact", "t", n, long_stem), _starts("c_compact", "t", n)),
        (_whole("v_stem_identity", "i", n, long_stem), _starts("c_identity", "i", n)),
    ]


def _strict_keys() -> list[Keys]:
    seen, named = F.col("v_strict") != "", F.col("c_strict") != ""
    return [
        (_whole("v_strict", "="), F.concat(_whole("c_strict", "="), _whole("c_core_fold", "=", when=named))),
        (_whole("v_full_fold", "<", CUT_LEN, seen), F.concat(_starts("c_full_low", "<", CUT_LEN, when=named), _starts("c_core_fold", "<", CUT_LEN, when=named))),
    ]


def _aligned_keys() -> list[Keys]:
    return [(_whole("v_align", "~"), _whole("c_align", "~")), (_starts("v_align", ">", 3), _whole("c_align", ">", 3)), (_whole("v_align", "?", 3), _starts("c_align", "?", 3))]


def _meeting(v: DataFrame, c: DataFrame, keys: list[Keys]) -> DataFrame:
    """``v, c``: pairs of names that share a key. Each part's keys have a tag of their own, so all parts are one join."""
    left, right = ([k[i] for k in keys] for i in (0, 1))
    spread = lambda rows, name, arrays: rows.select(F.col("name").alias(name), F.explode(F.array_distinct(F.concat(*arrays))).alias("key"))
    return spread(v, "v", left).join(spread(c, "c", right), "key").select("v", "c")


def _rarest_gram(rows: DataFrame, p: str, counts: DataFrame) -> DataFrame:
    """``name, x, gram``: of each title's trigrams, the one that the fewest titles of the other side have; a title with one that none has is in no other."""
    grams = rows.filter(F.char_length(f"{p}low") >= LOOSE_LEN).select("name", F.col(f"{p}low").alias("x"), F.explode(F.array_distinct(_trigrams(F.col(f"{p}low")))).alias("gram"))
    found = grams.join(counts, "gram", "left").groupBy("name", "x").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rare"))
    return found.filter("rare.n > 0").select("name", "x", F.col("rare.gram").alias("gram"))


def _trigrams(x: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(x) - LOOSE_LEN + 1), lambda i: F.substring(x, i, F.lit(LOOSE_LEN)))


def _within(short: DataFrame, p: str, long: DataFrame, q: str) -> DataFrame:
    """``name, other``: titles of ``short`` that are a part of longer ones of ``long``: candidates share the short one's rarest trigram."""
    grams = long.filter(F.char_length(f"{q}low") > LOOSE_LEN).select(F.col("name").alias("other"), F.col(f"{q}low").alias("y"), F.explode(F.array_distinct(_trigrams(F.col(f"{q}low")))).alias("gram"))
    rare = _rarest_gram(short, p, grams.groupBy("gram").agg(F.count("*").alias("n")))
    return rare.join(grams, "gram").filter((F.char_length("x") < F.char_length("y")) & F.contains("y", F.col("x"))).select("name", "other")


def _alike(small: DataFrame, p: str, large: DataFrame, q: str, equal: bool) -> DataFrame:
    """``name, other``: candidates for cores of which most characters are in a core at least as long (``equal``) or longer.

    Of a core of n characters, of which m must be in the other, any n - m + 1 hold one of those, so the rarest ones are its keys. A core of a
    word and a number is never like one of the same word and another number; such pairs are told apart by their word, all names of a word at once, before any two of them meet."""
    n = F.char_length(f"{p}title_core")
    needed = F.greatest(F.lit(3), F.ceil(n * 0.72)).cast("int")
    own = small.filter((n >= 2) & (needed <= n)).select("name", F.col(f"{p}title_core").alias("x"), F.col(f"{p}word").alias("word"), F.col(f"{p}number").alias("number"), (n - needed + 1).alias("few"))
    others = large.filter(f"{q}title_core != ''").select(F.col("name").alias("other"), F.col(f"{q}title_core").alias("y"), F.col(f"{q}word").alias("of_word"), F.col(f"{q}number").alias("of_number"))
    letters = others.select("*", F.explode(F.array_distinct(F.split("y", ""))).alias("ch"))
    rarity = letters.groupBy("ch").agg(F.count("*").alias("n"))
    each = own.select("name", "x", "word", "number", "few", F.posexplode(F.split("x", "")).alias("pos", "ch")).join(rarity, "ch", "left")
    order = F.row_number().over(W.partitionBy("name").orderBy(F.coalesce("n", F.lit(0)), "ch", "pos"))
    rare = each.withColumn("nth", order).filter("nth <= few AND n > 0").select("name", "x", "word", "number", "ch").distinct()
    longer = F.char_length("y") >= F.char_length("x") if equal else F.char_length("y") > F.char_length("x")
    words = rare.select("word", "ch").distinct().join(letters.select("of_word", "ch").distinct(), "ch").filter("word IS NULL OR of_word IS NULL OR word != of_word")
    # names without a number have no word; they meet as they are
    met = rare.withColumn("w", F.coalesce("word", F.lit(""))).join(words.select(F.coalesce("word", F.lit("")).alias("w"), "ch", F.coalesce("of_word", F.lit("")).alias("of_w")), ["w", "ch"])
    apart = met.join(letters.withColumn("of_w", F.coalesce("of_word", F.lit(""))), ["of_w", "ch"]).filter(longer).select("name", "other")
    same = own.filter("word IS NOT NULL").join(others, (F.col("word") == F.col("of_word")) & (F.col("number") == F.col("of_number"))).filter(longer).select("name", "other")
    return apart.unionAll(same)


def _title_forms(rows: DataFrame, p: str) -> DataFrame:
    """Titles in lower case, and the word and the number that a core is made of, if it is."""
    core = F.col(f"{p}title_core")
    number = F.regexp_extract(core, NUMBERED, 2)
    return rows.filter(f"{p}title != ''").withColumns({f"{p}low": F.lower(f"{p}title"), f"{p}word": F.when(number != "", F.lower(F.regexp_extract(core, NUMBERED, 1))), f"{p}number": F.when(number != "", number)})


def _title_pairs(v: DataFrame, c: DataFrame) -> DataFrame:
    """``v, c``: candidates for titles that are alike."""
    v, c = _title_forms(v, "v_"), _title_forms(c, "c_")
    same = _meeting(v, c, [(_whole("v_low", ""), _whole("c_low", ""))])
    forth = [_within(v, "v_", c, "c_"), _alike(v, "v_", c, "c_", True)]
    back = [_within(c, "c_", v, "v_"), _alike(c, "c_", v, "v_", False)]
    pairs = [same, *[x.toDF("v", "c") for x in forth], *[x.select(F.col("other").alias("v"), F.col("name").alias("c")) for x in back]]
    return reduce(DataFrame.unionAll, pairs)


def matching_pairs(v: DataFrame, c: DataFrame, rule: str = "combined") -> DataFrame:
    """``v, c``: each pair of distinct names, seen (``v``: name and forms ``v_...``) and configured (``c``), that match by the rule."""
    if rule == "titles":
        found, judge = _title_pairs(v, c), titles_match(F.col("v_title"), F.col("c_title"), F.col("v_title_core"), F.col("c_title_core"))
    else:
        # names that share a key of the plain or the strict rule match by it, if none of their labels is empty; a pair of the combined rule is strict or aligned
        keys = {"plain": _plain_keys, "strict": _strict_keys, "combined": lambda: [*_strict_keys(), *_aligned_keys()]}[rule]()
        found, judge = _meeting(v, c, keys), {"plain": names_match, "strict": names_match_strict, "combined": combined_match}[rule]()
    return found.distinct().join(v.withColumnRenamed("name", "v"), "v").join(c.withColumnRenamed("name", "c"), "c").filter(judge).select("v", "c")


def match_names(visible: DataFrame, configured: DataFrame, v_name: str = "name", c_name: str = "configured", rule: str = "combined") -> DataFrame:
    """All pairs of a visible row and a configured name that match by the rule: ``plain``, ``strict``, ``titles`` or ``combined``.

    Each distinct name is matched once, however many rows have it. Candidates come from equality joins of whole forms with starts of forms (of names: nearly all of them match), or of titles' rarest trigrams and
    characters; only distinct names and their keys are shuffled for that. The pairs found are joined with the rows: without a shuffle of these if the pairs are few, which is checked."""
    v = with_keys(visible.select(F.col(v_name).alias("name")).filter("name is not null").distinct(), "name", "v_")
    c = with_keys(configured.select(F.col(c_name).alias("name")).filter("name is not null").distinct(), "name", "c_")
    listed = configured.select(F.col(c_name).alias("c"), *[F.col(x).alias(f"__c{i}") for i, x in enumerate(configured.columns)])
    pairs = matching_pairs(v, c, rule).join(listed, "c").drop("c")
    some = pairs.limit(BROADCAST_PAIRS + 1).collect()
    if len(some) <= BROADCAST_PAIRS:
        pairs = F.broadcast(visible.sparkSession.createDataFrame(some, pairs.schema))
    rows = visible.select(F.col(v_name).alias("v"), *[F.col(x).alias(f"__v{i}") for i, x in enumerate(visible.columns)]).join(pairs, "v")
    return rows.select(*[F.col(f"__v{i}").alias(x) for i, x in enumerate(visible.columns)], *[F.col(f"__c{i}").alias(x) for i, x in enumerate(configured.columns)])


# F4, F5
def chat_type_allows(kind: str) -> Column:
    """Rows whose kind is unknown pass every setting."""
    kind = T.chat_kind(kind)
    return F.lit(True) if kind == "all" else F.col("is_group").isNull() | (F.col("is_group") == F.lit(kind == "group"))


def has_unread(rule: str = "present") -> Column:
    badge = F.col("badge_text")
    if rule == "present":
        return badge.isNotNull()
    return F.coalesce(~F.lower(T.utrim(badge)).isin("", "null", "none"), F.lit(False))


# F10, J6
def allowed_rows(rows: DataFrame, names: DataFrame, name: str = "name", configured: str = "configured", rule: str = "combined") -> DataFrame:
    """Rows whose name matches any of the list; an empty list, or one of ``*`` alone, keeps all."""
    few = [r[0] for r in names.select(configured).limit(2).collect()]
    if not few or few == ["*"]:
        return rows
    hits = match_names(rows.select(name).distinct(), names.select(configured), name, configured, rule).select(name).distinct()
    return rows.join(hits, name, "left_semi")


#: Configured names of a block.
NAME_BLOCK = 5_000


# J5
def resolved_chats(rows: DataFrame, configured: DataFrame, kind: str = "all", unread_only: bool = False) -> DataFrame:
    """``scan_id, configured, position, row_pos, name``: for each scan and configured name (``configured``, ``position``) its first matching CHATROW, or nulls.

    A scan's found names are taken from the list of all, block by block, so each pair is computed once."""
    seen = rows.filter(chat_type_allows(kind) & (has_unread() if unread_only else F.lit(True)))
    first = match_names(seen, configured).groupBy("scan_id", "configured", "position").agg(F.min("row_pos").alias("row_pos"), F.min_by("name", "row_pos").alias("name"))
    blocks = max(1, -(-configured.count() // NAME_BLOCK))
    block, one = F.pmod(F.xxhash64("configured", "position"), F.lit(blocks)).cast("int").alias("__b"), F.struct("configured", "position")
    every = configured.groupBy(block).agg(F.collect_list(one).alias("__all"))
    found = first.groupBy("scan_id", block).agg(F.collect_list(F.struct("configured", "position", "row_pos", "name")).alias("__found"))
    scans = rows.select("scan_id").distinct().withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    left = scans.join(every, "__b").join(found, ["scan_id", "__b"], "left")
    kinds = dict(rows.dtypes)
    hit = F.coalesce("__found", F.array().cast(found.schema["__found"].dataType))
    names = F.transform(hit, lambda n: F.struct(n["configured"].alias("configured"), n["position"].alias("position")))
    missed = F.transform(F.array_except("__all", names), lambda n: F.struct(n["configured"].alias("configured"), n["position"].alias("position"), F.lit(None).cast(kinds["row_pos"]).alias("row_pos"), F.lit(None).cast("string").alias("name")))
    return left.select("scan_id", F.explode(F.concat(hit, missed)).alias("n")).select("scan_id", "n.*")


def resolve_chats(rows: DataFrame, configured: DataFrame, kind: str = "all", unread_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """For each configured name its first matching CHATROW of a scan, and the names without any."""
    all_names = resolved_chats(rows, configured, kind, unread_only)
    return all_names.filter("row_pos is not null").orderBy("scan_id", "row_pos", "position"), all_names.filter("row_pos is null").select("scan_id", "configured", "position")


#: Scans with more distinct names than this are decided in rounds.
WALK = 100_000


# D10
def first_seen(names: DataFrame, scan: str = "scan_id", name: str = "name", pos: str = "row_pos") -> DataFrame:
    """Names of a scan without those whose key was seen, or that align with an earlier accepted name.

    Only the first row of each key and aligned form can be accepted, so only distinct names are looked at: of a scan of up to WALK ones in a walk, of a larger one in rounds of joins (:func:`_accepted_in_rounds`)."""
    keyed = with_keys(names, name, "n_").withColumn("n_key", T.chat_key(F.col(name))).select(*names.columns, "n_key", "n_align").filter("n_key != ''")
    n = F.row_number().over(W.partitionBy(scan, "n_key", "n_align").orderBy(pos, name))
    keyed = keyed.withColumn("n_n", n).filter("n_n = 1").drop("n_n")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        keys, starts, whole, keep = set(), set(), set(), []
        for r in group.sort_values([pos, name]).itertuples():
            # an earlier name is a start of this one, or this one of an earlier: three characters at least, or all
            a = r.n_align
            alike = a in whole or (len(a) >= 3 and a in starts) or any(a[:k] in whole for k in range(3, len(a)))
            if r.n_key not in keys and not (a and alike):
                keys.add(r.n_key)
                if a:
                    whole.add(a)
                    starts.update(a[:k] for k in range(3, len(a) + 1))
                keep.append(r.Index)
        return group.loc[keep]

    small = lambda rows: rows.groupBy(scan).applyInPandas(walk, keyed.schema).drop("n_key", "n_align")
    large = names.groupBy(F.col(scan).alias("__scan")).agg(F.count("*").alias("__n")).filter(F.col("__n") > WALK).select("__scan")  # no scan has more names than rows
    if large.isEmpty():
        return small(keyed)
    same = F.col(scan).eqNullSafe(F.col("__scan"))
    rest = small(keyed.join(large, same, "left_anti"))
    return rest.unionByName(_accepted_in_rounds(keyed.join(large, same, "left_semi"), scan, [pos, name]).select(*names.columns))


def _accepted_in_rounds(keyed: DataFrame, scan: str, order: list[str]) -> DataFrame:
    """Rows (with ``n_key`` and ``n_align``) that a walk over each scan in order accepts.

    In each round a name is accepted if no earlier undecided one has its key or aligns with it; then those go that share a key or align with an accepted one, and the others wait for the next
    round. An accepted name is always earlier than what it turns away, as it was the earliest of all that it touches. Touching is found by sums over forms and their starts, and not over pairs of names: the earliest place of each
    key, of each whole form and of each start. There are as many rounds as the longest chain of names of which each waits for the one before."""
    spark = keyed.sparkSession
    base = f"{scratch(spark)}/confab-{uuid.uuid4().hex}"

    def stored(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{base}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{base}/{name}")

    in_scan = F.coalesce(F.concat(F.lit("s"), F.col(scan).cast("string")), F.lit("-")).alias("__s")
    waiting = stored(running(keyed.select("*", in_scan), ["__s"], [F.col(c) for c in order], "__o"), "names")
    parts, turn = [], 0
    of_starts = F.explode(F.transform(F.sequence(F.lit(3), F.greatest(F.char_length("n_align"), F.lit(3))), lambda k: F.substring("n_align", F.lit(1), k))).alias("x")
    long = F.char_length("n_align") >= 3
    while not waiting.isEmpty():
        turn += 1
        keys = waiting.groupBy("__s", "n_key").agg(F.min("__o").alias("__k"))
        whole = waiting.filter("n_align != ''").groupBy("__s", "n_align").agg(F.min("__o").alias("__e"))
        starts = waiting.filter(long).select("__s", "__o", of_starts)
        of_longer = starts.groupBy("__s", "x").agg(F.min("__o").alias("__m")).withColumnRenamed("x", "n_align")
        of_shorter = starts.join(whole.withColumnRenamed("n_align", "x"), ["__s", "x"]).groupBy("__s", "__o").agg(F.min("__e").alias("__b"))
        seen = waiting.join(keys, ["__s", "n_key"]).join(whole, ["__s", "n_align"], "left").join(of_longer, ["__s", "n_align"], "left").join(of_shorter, ["__s", "__o"], "left")
        first = F.least("__k", F.coalesce("__e", "__o"), F.coalesce("__m", "__o"), F.coalesce("__b", "__o")) >= F.col("__o")
        judged = stored(seen.withColumn("__first", first).select(*waiting.columns, "__first"), f"round{turn}")
        taken, others = judged.filter("__first").drop("__first"), judged.filter("NOT __first").drop("__first")
        parts.append(taken)
        forms = taken.filter("n_align != ''").select("__s", "n_align").distinct()
        longer = taken.filter(long).select("__s", of_starts).distinct().withColumnRenamed("x", "n_align")
        under = others.filter(long).select("__s", "__o", of_starts).join(forms.withColumnRenamed("n_align", "x"), ["__s", "x"], "left_semi").select("__s", "__o").distinct()
        left = others.join(taken.select("__s", "n_key").distinct(), ["__s", "n_key"], "left_anti").join(forms, ["__s", "n_align"], "left_anti").join(longer, ["__s", "n_align"], "left_anti")
        waiting = stored(left.join(under, ["__s", "__o"], "left_anti").select(*waiting.columns), f"left{turn}")
    out = stored(reduce(DataFrame.unionAll, parts).select(*keyed.columns) if parts else keyed.limit(0), "accepted")
    remove(spark, f"{base}/names", *[f"{base}/{x}{t}" for t in range(1, turn + 1) for x in ("round", "left")])
    return out
