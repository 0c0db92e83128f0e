"""The ten operators against brute force on small tables, with nulls, empty and long texts, ties, repeats, empty tables and other columns."""

import hashlib
import importlib.util
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from confab.llm import bpe, common, exact_dedup, lm, near_dedup, packing, pii, quality, queries, sharding, topk, url_filter

DOC = "doc_id long, text string, lang string, kept string, rid string, score string, name string, ids string"


def table(spark, texts, first=0):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(first + i, t, "en", "k", "r", "s", "n", "i") for i, t in enumerate(texts)], DOC)


def on_files(df):
    return common.store(df, "docs")


ODD = [None, "", " \n\t", "a", "one two three", "word " * 30_000, "é ü ß 中文 😀", "a", "a ", "\x00\x1f"]
SPACE = re.compile(r"[\x20\x09-\x0D]+")


# --- 10 exact dedup ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [3, 4096])
def test_exact_groups(spark, block):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choices("ab ", k=rng.randrange(12))) for _ in range(120)]
    got = {r.doc_id: r for r in exact_dedup.exact_groups(on_files(table(spark, texts[:5] + texts[6:] if block == 3 else texts)), block=block).collect()}
    texts = texts[:5] + texts[6:] if block == 3 else texts
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i))
    assert len(got) == len(texts)
    for norm, own in groups.items():
        keep = min(own)[1]
        for _, i in own:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (keep, len(own), i == keep)
            assert got[i].text_sha256 == hashlib.sha256(norm.encode()).hexdigest()


def test_exact_repeated_rows_null_ids_and_empty(spark):
    rows = [(None, "x", "", "", "", "", "", ""), (5, "x", "", "", "", "", "", ""), (5, "x", "", "", "", "", "", "")]
    docs = on_files(spark.createDataFrame(rows, DOC))
    out = exact_dedup.exact_groups(docs).collect()
    assert [r.keep_id for r in out] == [5] * 3 and sum(r.kept for r in out) == 1
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [5]
    assert exact_dedup.exact_groups(on_files(docs.limit(0))).count() == 0


# --- 3 pseudonyms --------------------------------------------------------------------------------------------------


def brute_text(key, text):
    """The Feistel permutation of a text's shape, in plain Python."""
    half = len(text) // 2
    l, r = text[:half], text[half:]

    def shift(part, other, i):
        h = hashlib.sha256(f"{key}|{i}|{other}".encode()).hexdigest()
        out = ""
        for k, c in enumerate(part):
            by = int(h[(k % 32) * 2 : (k % 32) * 2 + 2], 16)
            for first, n in (("0", 10), ("a", 26), ("A", 26)):
                if c.isascii() and ord(first) <= ord(c) < ord(first) + n:
                    c = chr((ord(c) - ord(first) + by) % n + ord(first))
                    break
            out += c
        return out

    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            l = shift(l, r, i)
        else:
            r = shift(r, l, i)
    return l + r


def test_permutation_equals_brute_force(spark):
    values = ["", "7", "42", "abc.D9", "0123456789" * 9, "x_-Z"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r.o for r in df.select(pii.permute_text("k", F.col("v")).alias("o")).collect()] == [brute_text("k", v) for v in values]


def test_permutations_lose_nothing(spark):
    three = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"))
    assert three.select(pii.permute_text("k", F.col("v")).alias("o")).distinct().count() == 1000
    a, b = pii.DAYS
    days = spark.range(a * b).select(pii.permute_pair("k", F.floor(F.col("id") / b), F.col("id") % b, a, b).alias("o"))
    assert days.distinct().count() == a * b and days.filter(~F.col("o.l").between(0, a - 1) | ~F.col("o.r").between(0, b - 1)).count() == 0


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def pseudonyms(spark, *texts):
    return [(r.text, r.found) for r in pii.pseudonymise(table(spark, texts), "k", found="found").orderBy("doc_id").collect()]


def test_pseudonyms(spark):
    (text, n), (again, _) = pseudonyms(spark, "card 4539 1488 0343 6467, mail a.b9@mail1.example.com, call +1 (743) 555-3824, ip 152.143.123.131### born 2020-02-29 or 31.12.1999", "(4539148803436467)")
    assert n == 6
    for old in ("4539 1488", "a.b9@", "555-3824", "152.143", "2020-02-29", "31.12.1999"):
        assert old not in text
    card = re.search(r"card ([\d ]{19}),", text)[1]
    assert luhn(card.replace(" ", "")) and card.replace(" ", "") in again
    assert re.search(r"mail [a-z]\.[a-z]\d@mail1\.example\.com, call \+1 \(\d{3}\) \d{3}-\d{4}, ip (\d{1,3}\.){3}\d{1,3}###", text)
    assert re.search(r"born \d{4}-\d\d-\d\d or \d\d\.\d\d\.\d{4}$", text)
    (iban, n), = pseudonyms(spark, "DE89 3704 0044 0532 0130 00")
    turned = "".join(str(int(c, 36)) for c in (iban[4:] + iban[:4]).replace(" ", ""))
    assert n == 1 and int(turned) % 97 == 1 and iban != "DE89 3704 0044 0532 0130 00"
    assert pseudonyms(spark, "123-45-6789")[0][0].startswith("123-") and pseudonyms(spark, "123-45-6789")[0][1] == 1


def test_what_stays(spark):
    clean = ["8007782375593431 no card", "4539148803436468 wrong digit", "token = \"4439e3e49cf46b2d7c90f3602a3d0b907ff\"", "02/30/2001", "999.1.1.1", "GB00 0000 0000 0000 0000 00", "000-12-3456", "v1.2.3", None, ""]
    assert pseudonyms(spark, *clean) == [(t, 0) for t in clean]
    long = "word " * 50_000 + "a@b.example " + "x" * 200_000
    assert pseudonyms(spark, long)[0][1] == 1
    empty = pii.pseudonymise(table(spark, ["x"]).limit(0), "k")
    assert empty.columns == table(spark, ["x"]).columns and empty.count() == 0


def test_cards_and_ibans_beside_numbers_and_words(spark):
    card, iban = "4539 1488 0343 6467", "BE68 5390 0754 7034"
    around = [
        ("", " 123"), ("", " 12/27"), ("no 12 ", ""), ("", " 12/27 123"), ("40 ", " 7"), ("12-", "-123"), ("", " 4222 2222"), ("tel ", ", 999"), ("8007 782 ", " 1"),
    ]
    alone = pseudonyms(spark, card)[0][0]
    assert alone != card and luhn(alone.replace(" ", ""))
    assert pseudonyms(spark, *(a + card + b for a, b in around)) == [(a + alone + b, 1) for a, b in around]
    # neighbours by which the whole run passes the issuer and Luhn tests
    hidden = [f"40{i} {card}" for i in range(10)] + [f"{card} {i}23" for i in range(10)]
    assert sum(luhn(x.replace(" ", "")) for x in hidden) == 2
    assert pseudonyms(spark, *hidden) == [(x.replace(card, alone), 1) for x in hidden]
    for text in (f"{card} 2027-12-31", f"+49 30 1234 5678 {card}", f"{card} {card}", f"{iban} {card}", f"1234 345-678-9012, {card}", f"1234 345-678-9012 {card}"):
        (new, n), = pseudonyms(spark, text)
        assert n == 2 and alone in new and not any(x in new for x in (card, iban, "2027-12-31", "1234 5678", "678-9012"))
    odd = "453914 88034 36467"
    (new, n), = pseudonyms(spark, f"{odd} 12")
    assert n == 1 and new.endswith(" 12") and new.replace(" ", "")[:16] == alone.replace(" ", "")
    alone = pseudonyms(spark, iban)[0][0]
    assert alone != iban
    ends = ["", " EUR", " BIC", " EURO", " 12", " PLEASE PAY", "."]
    assert pseudonyms(spark, *(iban + x for x in ends)) == [(alone + x, 1) for x in ends]
    assert pseudonyms(spark, *(iban.replace(" ", "") + x for x in ends)) == [(alone.replace(" ", "") + x, 1) for x in ends]


def test_pseudonyms_are_valid_again(spark):
    rng = random.Random(3)
    ssns = [f"{rng.randrange(1, 666):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10_000):04d}" for _ in range(4000)]
    cards = []
    for prefix, n in (("4", 16), ("4", 13), ("51", 16), ("2221", 16), ("2720", 16), ("34", 15), ("6011", 16)):
        for _ in range(150):
            body = prefix + "".join(rng.choices("0123456789", k=n - len(prefix) - 1))
            cards.append(next(body + str(d) for d in range(10) if luhn(body + str(d))))
    phones = ["(212) 555-0100", "+1 212 555 0100", "+12125550100", "212-555-0100", "+491701234567", "+49 170 1234567", "+49 (170) 123-4567"]
    dates = ["31/12/1999", "25/11/1990", "12/31/1999", "31.12.1999", "1999-12-31", "30/02/1999", "13/01/1900"]
    values = [*dict.fromkeys(ssns), *dict.fromkeys(cards), *phones, *dates]
    got = dict(zip(values, pseudonyms(spark, *values), strict=True))
    new = [got[x][0] for x in dict.fromkeys(ssns)]
    assert len(set(new)) == len(new) and all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x) for x in new)
    for old in dict.fromkeys(cards):
        x = got[old][0]
        assert luhn(x) and len(x) == len(old) and x[:1] == old[:1] and (x[:4] == old[:4] or x[0] == "4")
    assert len({got[x][0] for x in cards}) == len(set(cards))
    digits = lambda x: re.sub(r"\D", "", got[x][0])
    assert len({digits(x)[-10:] for x in phones[:4]}) == 1 and re.fullmatch(r"[2-9]\d\d[2-9]\d{6}", digits(phones[0]))
    assert len({digits(x) for x in phones[4:]}) == 1 and digits(phones[4]).startswith("491") and digits(phones[4]) != "491701234567"
    assert got["30/02/1999"] == ("30/02/1999", 0)
    for x in ("31/12/1999", "25/11/1990", "13/01/1900"):
        d, m, y = map(int, got[x][0].split("/"))
        assert got[x][0] != x and 12 < d and m <= 12 and 1900 <= y < 2100
    assert got["12/31/1999"][0].split("/") == [got["31.12.1999"][0].split(".")[i] for i in (1, 0, 2)]
    assert got["1999-12-31"][0].split("-") == got["31.12.1999"][0].split(".")[::-1]


def test_long_addresses_do_not_recurse(spark):
    many = "x@a" + ".a" * 100_000
    (text, n), (other, m), (rest, k) = pseudonyms(spark, f"to {many} end", "ab" * 50_000 + "@b.example", "1.2" * 50_000)
    assert n == 1 and text.endswith(many[1:] + " end") and m == 1 and other.endswith("@b.example") and (rest, k) == ("1.2" * 50_000, 0)


# --- 2 sharding ----------------------------------------------------------------------------------------------------


def shards_of(spark, texts):
    sizes = common.store(sharding.document_sizes(table(spark, texts)), "sizes")
    out = sharding.balanced_shards(sizes, ["n_chars", "text_crc32"], 8)
    return sharding.with_slots(out, "shard", F.struct("doc_id", "text_crc32")).toPandas()


def test_shards_are_even_whole_and_gapless(spark):
    rng = random.Random(2)
    letters = lambda n: "".join(rng.choices("abcdefgh", k=n))
    texts = ["hot copy of a text"] * 400 + [letters(60)] * 700 + ["one copy fewer"] * 30 + [letters(rng.randrange(60)) for _ in range(8000)] + [None, "", None]
    out = shards_of(spark, texts)
    assert len(out) == len(texts) and set(out.shard) == set(range(8))
    per = out.groupby("shard")["size"].sum()
    assert per.max() - per.min() <= 0.02 * per.mean()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    for r in out.itertuples():
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    # 700 copies are more than a shard has, so they alone lie in several
    assert per.mean() < 700 * 61
    split = out.groupby("text_crc32")["shard"].nunique()
    assert split[split > 1].index.tolist() == [zlib.crc32(texts[500].encode())]


def test_shards_of_little(spark):
    assert len(shards_of(spark, ODD)) == len(ODD)
    assert len(shards_of(spark, ["x"])) == 1
    empty = common.store(sharding.document_sizes(table(spark, ["x"]).limit(0)), "sizes")
    assert sharding.with_slots(sharding.balanced_shards(empty, ["n_chars"], 8), "shard", F.col("doc_id")).count() == 0
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else f"s{i % 5}", 10, "old", 1, "c") for i in range(100)], "i int, source string, size int, shard string, node int, dim string")
    shards = sharding.kd_shards(rows, ["source", "i"], "size", F.col("i"), target_bytes=250)
    by_bytes = shards.groupBy("shard").sum("size").collect()
    assert len(by_bytes) == 4 and all(r[1] == 250 for r in by_bytes) and sorted(shards.columns) == sorted(rows.columns) and shards.filter("node = 1 and dim = 'c'").count() == 100
    # texts that differ behind a long common start, and repeated rows
    names = spark.createDataFrame([(f"the same long start {i // 10:03d}", 1) for i in range(400)], "name string, size int")
    parts = sharding.kd_shards(names, ["name"], "size", F.lit(0), n_leaves=4).groupBy("shard").agg(F.count("*").alias("n"), F.min("name").alias("a"), F.max("name").alias("b")).orderBy("shard").collect()
    assert [r.n for r in parts] == [100] * 4 and all(x.b < y.a for x, y in zip(parts, parts[1:]))


# --- 4, 5 tokens ---------------------------------------------------------------------------------------------------

needs_vocabulary = pytest.mark.skipif(importlib.util.find_spec("public_tokenizers") is None, reason="no vocabulary files here")


def hard_texts():
    rng = random.Random(4)
    out = [*ODD, "Hello <|endoftext|>World it's don't we'LL 'S 12345", "aaaaaa bbbbbbb ababababab", "x" * 3000, "naïve İstanbul ΑΣ ﬁ é \u0085 \u2003 q", "''s'tt </w> <|x"]
    for alphabet in ("aeinrst'h ", "abAB12!?. ", "éàüß çñ'", [chr(c) for c in (*range(32, 127), *range(0xA0, 0x250), *range(0x300, 0x330), *range(0x2000, 0x2040), *range(0x4E00, 0x4E20))]):
        out += ["".join(rng.choices(alphabet, k=rng.randrange(80))) for _ in range(150)]
    return out


@needs_vocabulary
def test_encoding_equals_the_library(spark):
    texts = hard_texts()
    path = queries.tokenizer_path()
    library = bpe.vocabulary(path).library
    out = {r.doc_id: r for r in bpe.encode(table(spark, texts), path, decoded="decoded").collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert out[i].ids == ids and out[i].decoded == library.decode(ids, skip_special_tokens=False), t
    assert bpe.encode(table(spark, ["x"]).limit(0), path).count() == 0


@needs_vocabulary
@pytest.mark.parametrize("length", [5, 2048])
def test_packing(spark, length):
    path, texts = queries.tokenizer_path(), hard_texts()[:200]
    library = bpe.vocabulary(path).library
    pieces = packing.pack(table(spark, texts).repartition(3), path, length=length).toPandas().sort_values(["sequence_id", "offset"])
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert ((pieces.sequence_id * length + pieces.offset) == pieces.length.cumsum() - pieces.length).all()
    got = {}
    for r in pieces.sort_values(["doc_id", "start"]).itertuples():
        assert r.start == len(got.setdefault(r.doc_id, [])) and r.offset + r.length <= length and r.doc_tokens == len(want[r.doc_id])
        got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert got == want
    assert packing.pack(table(spark, ["x"]).limit(0), path).count() == 0


# --- 6 urls --------------------------------------------------------------------------------------------------------


def brute_url(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_urls(spark):
    urls = [None, "", "no scheme/net/", "http://NET/", "http://a.net", "https://a.Example.net/en/x?y#z", "http://example.net/fr/", "http://notexample.com/de/", "http://x.example.com/de/1", "http://ex.org/fr/#q", "x://a://b/c", "http://é.net/\nz", "http://net.example.org/fr", "://h/p"] + ["http://a.net/1"] * 30 + [f"http://w{i}.example.org/fr/{i}" for i in range(30)]
    rows = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id int, url string, verdict string").withColumns({"features": F.lit("f"), "host": F.lit("h"), "probability": F.lit("p")})
    out = {r.page_id: r for r in url_filter.judge(rows, queries.URL_RULES).collect()}
    assert len(out) == len(urls)
    for i, u in enumerate(urls):
        assert (out[i].host, out[i].path, out[i].rule) == brute_url(u, queries.URL_RULES), u
        assert (out[i].features, out[i].probability, out[i].url) == ("f", "p", u)
        assert out[i].verdict == queries.URL_RULES[out[i].rule] if out[i].rule else out[i].verdict in ("allow", "block")
    assert url_filter.judge(rows.filter("page_id < 3"), queries.URL_RULES).select("verdict").distinct().collect()[0][0] == "allow"
    assert url_filter.judge(rows.limit(0), queries.URL_RULES).count() == 0


def test_url_model_on_a_bounded_sample(spark):
    many = spark.range(6000).select(F.concat(F.lit("w"), "id", F.lit(".win")).alias("host"), F.lit("/bet").alias("path"), F.lit(1.0).alias("label"))
    few = spark.range(3).select(F.concat(F.lit("s"), "id", F.lit(".edu")).alias("host"), F.lit("/").alias("path"), F.lit(0.0).alias("label"))
    model = url_filter.train(many.unionByName(few), max_rows=100)
    assert not isinstance(model, float)
    assert url_filter.train(many, max_rows=100) == 1.0 and url_filter.train(many.limit(0)) == 0.0


def test_url_model_learns(spark):
    label = [(f"casino{i}.win", f"/bet/{i}", 1.0) for i in range(60)] + [(f"school{i}.edu", f"/lesson/{i}", 0.0) for i in range(60)]
    model = url_filter.train(spark.createDataFrame(label, "host string, path string, label double"))
    new = spark.createDataFrame([("http://casino99.win/bet/x",), ("http://school99.edu/lesson/x",)], "url string")
    assert {r.url.split("/")[2]: r.verdict for r in url_filter.judge(new, {}, model).collect()} == {"casino99.win": "block", "school99.edu": "allow"}


# --- 1 quality -----------------------------------------------------------------------------------------------------


def test_quality_learns_and_scores_all(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 8)))
    good = [" ".join(word() for _ in range(rng.randrange(20, 90))) + "." for _ in range(300)]
    bad = [" ".join(word().upper() + "!!" for _ in range(rng.randrange(20, 90))) for _ in range(120)] + ["buy " * rng.randrange(20, 80) for _ in range(120)]
    texts = good + bad
    stats = common.store(quality.with_statistics(table(spark, texts)), "stats")
    labelled = stats.withColumn("label", (F.col("doc_id") < len(good)).cast("int")).filter("doc_id % 4 != 0")
    model = quality.fit(labelled)
    assert 0 < len(model.rules)
    scored = stats.select("doc_id", model.score().alias("p")).toPandas()
    held = scored[scored.doc_id % 4 == 0]
    assert ((held.p >= 0.3) == (held.doc_id < len(good))).mean() > 0.95
    odd = quality.with_statistics(table(spark, ODD)).select(model.score().alias("p")).collect()
    assert len(odd) == len(ODD) and all(0 <= r.p <= 1 for r in odd)


def test_quality_without_labels(spark):
    docs = table(spark, ODD)
    labels = lambda *rows: spark.createDataFrame(rows, "doc_id long, label int")
    stats = quality.with_statistics(docs)
    of = lambda model: stats.select(model.score().alias("p")).first().p
    known = quality.labelled_statistics(docs, labels((0, 1), (0, 1), (1, 2), (2, None), (99, 0), (None, 1)))
    assert [r.label for r in known.collect()] == [1.0, 1.0] and known.columns == ["label", *quality.STATS]
    assert of(quality.fit(known.limit(0))) == pytest.approx(0.5)
    assert of(quality.fit(known)) > 0.99
    assert quality.with_statistics(table(spark, ["x"]).limit(0)).count() == 0
    assert quality.labelled_statistics(docs, spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, label int"), max_rows=4).count() < 10


def test_statistics_replace_clashing_columns(spark):
    docs = table(spark, ["Aa bb!! ***", "Aa bb!! ***", None]).withColumn("s_upper", F.lit("x"))
    out = quality.with_statistics(docs, keep_text=True)
    assert out.columns == [c for c in docs.columns if c != "s_upper"] + quality.STATS
    rows = out.orderBy("doc_id").collect()
    assert rows[0][2:] == rows[1][2:] and rows[0].s_bare == pytest.approx(1 / 3) and rows[0].s_repeated_marks == pytest.approx(2 / 3) and set(rows[2][-len(quality.STATS):]) == {0.0}


def test_rules_are_paths():
    text = "Tree 0 (weight 1.0):\n If (feature 1 <= 0.5)\n  If (feature 0 <= 2.0)\n   Predict: 1.0\n  Else (feature 0 > 2.0)\n   Predict: 0.0\n Else (feature 1 > 0.5)\n  Predict: 0.0\n"
    up, words = quality.STATS[1], quality.STATS[0]
    assert quality._paths(text) == {((up, False, 0.5),), ((words, False, 2.0), (up, False, 0.5)), ((words, True, 2.0), (up, False, 0.5)), ((up, True, 0.5),)}


# --- 9 near-duplicates ---------------------------------------------------------------------------------------------


def brute_components(texts):
    sets = []
    for t in texts:
        w = [x for x in SPACE.split("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_groups(spark):
    rng = random.Random(7)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    shared = text(60)
    texts = [*ODD, *(text(80) + " " + shared + " " + text(80) for _ in range(60))]
    for n, edits in ((2, 3), (3, 5), (8, 4), (40, 5), (180, 5)):
        texts += near_copies(rng, text(120), n, edits)
    sizes, want = brute_components(texts)
    out = {r.doc_id: r for r in near_dedup.near_groups(on_files(table(spark, texts))).collect()}
    assert len(out) == len(texts)
    assert [out[i].n_shingles for i in range(len(texts))] == sizes
    assert [out[i].component_id for i in range(len(texts))] == want
    assert all(out[i].kept == (want[i] == i) for i in range(len(texts)))


def test_near_repeated_rows_and_empty(spark):
    rows = [(None, "a b c d e f", *[""] * 6), (5, "a b c d e f", *[""] * 6), (5, "A b c d e f", *[""] * 6), (6, None, *[""] * 6)]
    docs = on_files(spark.createDataFrame(rows, DOC))
    assert [r.component_id for r in near_dedup.near_groups(docs).orderBy("rid").collect()] == [5, 5, 5, 6]
    left = near_dedup.drop_near_copies(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [5, 6]
    assert near_dedup.near_groups(on_files(docs.limit(0))).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101)], "a long, b long")
    got = {r.v: r.c for r in near_dedup.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# --- 8 top-k -------------------------------------------------------------------------------------------------------


def brute_top(vectors, k, step):
    ok = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    return {(q, n + 1): (i, s) for q in ok if q % step == 0 for n, (s, i) in enumerate(sorted(((dot(ok[q], ok[i]), i) for i in ok if i != q), key=lambda t: (-t[0], t[1]))[:k])}


def test_products_of_large_values():
    x = np.array([[1 << 62, 1 << 62], [-(1 << 62), 3]], np.int64)
    y = np.array([[4, 4], [1, 0]], np.int64)
    assert topk.products(x, y).tolist() == [[(1 << 63) - 1, 1 << 62], [-(1 << 63), -(1 << 62)]]
    assert topk.products(x[:0], y).shape == (0, 2)


def test_top_k_of_large_values(spark):
    rows = spark.createDataFrame([(0, [3e9, 1.0]), (1, [3e9, 2.0]), (2, [-1e30, 0.0]), (3, [0.5, 1e30])], "vec_id long, embedding array<float>")
    out = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(rows, F.col("vec_id") == 0, 3).collect()}
    assert out[0, 1] == (1, min((1 << 63) - 1, int(768e9) ** 2 + 256 * 512)) and out[0, 3][0] == 2 and out[0, 3][1] == -(1 << 63)


@pytest.mark.parametrize("block", [16, 2048])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "GROUP", max(3, block // 8))
    if block < 100:
        monkeypatch.setattr(topk, "LEAF", 4)
        monkeypatch.setattr(topk, "TOGETHER", 3)
    rng = random.Random(8)
    vec = lambda: [rng.gauss(0, 0.2) for _ in range(6)]
    same = vec()
    vectors = [(i, vec()) for i in range(150)] + [(150 + i, same) for i in range(70)] + [(300, None), (301, []), (302, [None] * 6), (303, [float("nan")] * 6), (304, [float("inf"), *[0.0] * 5]), (305, [0.5])]
    rows = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<float>, score string")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(rows, F.col("vec_id") % 10 == 0).collect()}
    assert got == brute_top(vectors, 5, 10)


def test_cover_tree():
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=(700, 2)) * 100, np.concatenate([rng.normal(size=(300, 8)), np.ones((80, 8)) * 3, rng.normal(size=(5, 8)) * 1000]), np.zeros((90, 3)), rng.normal(size=(1, 4))):
        t = topk.CoverTree(x)
        assert sorted(t.order) == list(range(len(x)))
        far = lambda i, rows: np.sqrt(((x[rows] - x[i]) ** 2).sum(axis=1))
        for i in range(len(t.centre)):
            rows = t.order[t.first[i] : t.last[i]]
            assert t.centre[i] in rows and far(t.centre[i], rows).max() == pytest.approx(t.radius[i]) and t.radius[i] <= topk.BASE ** float(t.level[i]) * (1 + 1e-9)
            below = range(t.child[i], t.child[i] + t.children[i])
            if below:
                assert t.centre[below[0]] == t.centre[i] and sum(t.last[c] - t.first[c] for c in below) == len(rows)
                limit = topk.BASE ** float(t.level[i] - 1)
                assert all(t.level[c] <= t.level[i] - 1 for c in below)
                for c in below:
                    others = [t.centre[d] for d in below if d != c]
                    assert not others or far(t.centre[c], others).min() > limit * (1 - 1e-9)
        assert len(t.centre) > 1 or len(x) <= topk.LEAF or not t.radius[0]
        again = topk.CoverTree.of(x[t.order], t.packed())
        assert (again.at == x[t.centre]).all()


def test_top_k_of_little(spark):
    rows = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (0, [1.0]), (None, [1.0])], "vec_id long, embedding array<float>")
    out = [(r.query_id, r["rank"], r.vec_id) for r in topk.top_k(rows, F.col("vec_id") == 0).collect()]
    assert sorted(out) == [(0, 1, 1), (0, 1, 1), (0, 2, 0), (0, 2, 0)]
    assert topk.top_k(rows.limit(0), F.col("vec_id") == 0).count() == 0
    assert topk.top_k(rows, F.lit(False)).count() == 0


# --- 7 language model ----------------------------------------------------------------------------------------------


def lm_texts():
    rng = random.Random(9)
    follow = {w: rng.choices("abcdefghij", k=2) for w in "abcdefghij"}
    out = [*ODD]
    for _ in range(150):
        w = rng.choice("abcdefghij")
        words = []
        for _ in range(rng.randrange(5, 60)):
            words.append(w.upper() if rng.random() < 0.2 else w)
            w = rng.choice(follow[w])
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("tokens", [500, 2_500_000])
def test_lm(spark, monkeypatch, tokens):
    monkeypatch.setattr(lm, "BUCKET_TOKENS", tokens)
    texts = lm_texts()
    out = lm.score(on_files(table(spark, texts).repartition(3)), common.held_out("doc_id", 1)).toPandas().set_index("doc_id")
    toks = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in toks}
    count = {}
    for i, w in toks.items():
        for x in w if not held[i] else ():
            count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    assert len(out) == len(texts)
    for i, w in toks.items():
        r = out.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(x in count for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r.score < 0
    h = out[out.held_out]
    assert h.score.sum() > h.base_score.sum() * 0.8  # the model knows which word follows which


def test_lm_without_training_and_empty(spark):
    docs = on_files(table(spark, ["a b", None]))
    out = lm.score(docs, F.lit(True)).collect()
    assert len(out) == 2 and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in out)
    assert lm.score(on_files(docs.limit(0)), F.lit(True)).count() == 0


def test_contexts_are_words(spark):
    """Far more contexts than any hash of few bits tells apart: each word of a chain follows one other word alone."""
    words = [f"w{i}" for i in range(150_000)]
    texts = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
    mixed = [" ".join(words[i : i + 2000 : 2]) for i in range(0, len(words), 2000)]
    train = common.store(table(spark, texts * 3 + texts[:10] + mixed[:10]), "docs")
    out = lm.score(train, F.col("doc_id") >= 450).toPandas().set_index("doc_id")
    assert (out.train_tokens == 3 * (150_000 + 150)).all()
    # seen three times, the next word is nearly sure; after a skipped word it is not
    assert out.perplexity.loc[list(range(450, 460))].max() < 2 and out.perplexity.loc[list(range(460, 470))].min() > 1000


def test_seating():
    rng = np.random.default_rng(0)
    c = np.array([0, 1, 2, 50, 5000, 7])
    t = lm.seat(c, np.full(6, 0.5), 0.7, rng)
    assert (t <= c).all() and (t[c > 0] >= 1).all() and t[0] == 0 and t[4] > t[2]
    assert (lm.seat(c, np.full(6, 1e-12), 0.5, rng) == [0, 1, 1, 1, 1, 1]).all()


# --- the pipeline --------------------------------------------------------------------------------------------------


@needs_vocabulary
def test_pipeline(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = start = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for name, stage in cp.STAGES[:-1]:
        out = common.store(stage(spark, docs, sf), name)
        assert out.columns == start.columns
        seen.append((name, {r.doc_id: r.text for r in out.collect()}))
        docs = out
    (_, good), (_, exact), (_, near), (_, private) = seen
    assert set(good) >= set(exact) >= set(near) and set(near) == set(private)
    texts = {}
    for i, t in good.items():
        k = SPACE.sub("", t or "")
        texts[k] = min(texts.get(k, (1, 0)), (-len(t or ""), i))
    assert set(exact) == {i for _, i in texts.values()}
    ids = sorted(exact)
    _, want = brute_components([exact[i] for i in ids])
    assert set(near) == {ids[c] for c in set(want)}
    pieces = cp.packing_stage(spark, docs, sf).toPandas()
    library = bpe.vocabulary(queries.tokenizer_path()).library
    for i, g in pieces.sort_values("start").groupby("doc_id"):
        assert np.frombuffer(b"".join(g.ids), "<u4").tolist() == [*library.encode(private[i] or "", add_special_tokens=False).ids, 1]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(i in good for i, q in labels.items() if q == 1) and sum(i in good for i, q in labels.items() if q == 0) <= 1
