"""Format-preserving pseudonyms for personal data, with DataFrame functions alone.

Candidates are found by patterns and then validated: payment cards by issuer range and Luhn digit, IBANs by their
remainder modulo 97, US social security numbers by their areas, IPv4 addresses by their octets, dates by the calendar.
Cards and IBANs are looked for from every start of a group of digits, with every length that ends with a group, so numbers and
words beside them (security codes, expiry dates, telephone numbers) do not hide them. E-mails, IBANs and cards in a usual
layout are cut out of the text first, then other cards, and the remaining kinds are found in what is left.
What passes is run through a keyed Feistel network within its own format, a permutation of all values of that format:
equal values get equal pseudonyms in every document, different values get different ones, and lengths, separators,
letter cases and check digits stay valid. What fails validation stays as it is.

* cards: all digits but the check digit and those that name the issuer (the first four, of those that begin with 4 the first) are permuted,
  then the Luhn digit is set again, so every result is a valid card of the same issuer. Where spaces leave open how
  far a card goes, a usual layout (one group, 4-4-4-4, 4-6-5, 4-6-4) is taken before any other, then the longest from the left.
* IBANs: the account part is permuted, letters among letters, then the check digits are set again. A country of IBAN_LENGTHS
  has its length alone; with other countries all lengths from 15 to 34 are tried, the longest first.
* phone numbers (with ``+`` and country code, or as ``(ddd) ddd-dddd`` and ``ddd-ddd-dddd``): the digits after the country code, whose length
  the code itself tells, so all spellings of a number are linked. North American area and exchange codes go on to begin with 2 to 9 (or, where
  they did not, with 0 or 1); elsewhere the first digit after the code stays.
* e-mail addresses: letters, capitals and digits of the local part, each within its kind; the domain stays.
* social security numbers: serial and group digits, among those that are in use. IPv4 addresses: the 32-bit value.
* dates (ISO, d.m.y, m/d/y and, where that is no date, d/m/y, with four-digit years): the day's number within 200 years from 1900; other dates stay. The
  result of a d/m/y date is again one that cannot be read as m/d/y.

The key has no default: whoever knows it can undo the pseudonyms.

Edge cases: a null text stays null with no finds, an empty text stays empty; texts of any length are read whole, and no pattern
recurses. Of finds that overlap, the first in the text counts, and of those at one place the first kind above. Repeated rows get equal results; an empty table stays empty. Other
columns are untouched, whatever their names but for those beginning with two underscores. Rows are independent, so there is no shuffle and no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days from 1900-01-01 within which dates are permuted: 250 * 292.
DAYS = (250, 292)
#: Most steps along a cycle.
WALK = 48
#: A telephone number's country code, told by its first digits (fixed values).
COUNTRY_CODE = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

#: Each kind's pattern. Cards and IBANs are found by CARD_WINDOW and IBAN_WINDOW; of the others the first that fits at a place is taken.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]*[A-Za-z0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![A-Za-z0-9.+/-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![A-Za-z0-9/-])",
    "ssn": r"(?<![A-Za-z0-9+-])\d{3}-\d{2}-\d{4}(?![A-Za-z0-9-])",
    "ip": r"(?<![A-Za-z0-9.])\d{1,3}(?:\.\d{1,3}){3}(?![A-Za-z0-9]|\.\d)",
    "phone": r"(?<![A-Za-z0-9+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9.+-])\d(?:[ -]?\d){12,18}(?![A-Za-z0-9])",
}
OTHERS = "|".join(f"(?:{KINDS[n]})" for n in ("date", "ssn", "ip", "phone"))

#: What may not stand before a card (a hyphen may after a digit) and before an IBAN, and after both.
BEFORE_CARD, BEFORE_IBAN, AFTER = r"(?<![A-Za-z0-9.+])(?<![^0-9]-)(?<!^-)", "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"
#: The longest text at each place from where a card or an IBAN may begin.
CARD_WINDOW = BEFORE_CARD + r"(?=(\d(?:[ -]?\d){12,18}))"
IBAN_WINDOW = BEFORE_IBAN + r"(?=([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?))"
USUAL_CARD = r"^(?:\d+|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{4,5})$"
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}


def _hash(key: str, part: Column, i: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), i.cast("string"), part), 256)


def _number(hexes: Column, n: int = 15) -> Column:
    return F.conv(F.substring(hexes, 1, n), 16, 10).cast("long")


def permute_pair(key: str, left: Column, right: Column, a: int | Column, b: int | Column) -> Column:
    """Struct (l, r): a permutation of the pairs in ``[0, a) x [0, b)``."""

    def step(acc, i):
        l, r = acc["l"], acc["r"]
        even = i % 2 == 0
        new_l = F.when(even, (l + _number(_hash(key, r.cast("string"), i)) % a) % a).otherwise(l)
        new_r = F.when(even, r).otherwise((r + _number(_hash(key, l.cast("string"), i)) % b) % b)
        return F.struct(new_l.cast("long").alias("l"), new_r.cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _shift(text: Column, hexes: Column) -> Column:
    """Each digit and letter of ``text`` moved within its kind by the next byte of the key stream, which starts again after 32 characters."""

    def move(c, i):
        by = F.conv(F.substring(hexes, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        code = F.ascii(c)
        turn = lambda first, n: F.char((code - first + by) % n + first)
        return F.when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, 26)).when(c.between("A", "Z"), turn(65, 26)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), move), "")


def permute_text(key: str, text: Column) -> Column:
    """A permutation of all texts of the same shape (which places hold a digit, a small letter or a capital)."""
    half = F.floor(F.char_length(text) / 2).cast("int")

    def step(acc, i):
        l, r = acc["l"], acc["r"]
        even = i % 2 == 0
        return F.struct(F.when(even, _shift(l, _hash(key, r, i))).otherwise(l).alias("l"), F.when(even, r).otherwise(_shift(r, _hash(key, l, i))).alias("r"))

    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.char_length(text)).alias("r"))
    both = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return F.concat(both["l"], both["r"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits``, in order."""
    gaps = F.split(shape, "[0-9]", -1)
    return F.array_join(F.zip_with(gaps, F.concat(F.split(digits, ""), F.array(F.lit(""))), lambda g, d: F.concat(g, F.coalesce(d, F.lit("")))), "")


def _luhn(digits: Column) -> Column:
    """The sum of ``digits`` by Luhn's rule, the last digit counting once."""
    marks = F.split(F.reverse(digits), "")
    return F.aggregate(
        F.transform(marks, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int"))), F.lit(0), lambda s, d: s + d
    )


def _remainder97(text: Column) -> Column:
    """An IBAN's remainder: the first four characters go last, letters count from A = 10."""
    turned = F.concat(F.substring(text, F.lit(5), F.char_length(text)), F.substring(text, F.lit(1), F.lit(4)))
    digit = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda s, c: F.when(c.between("0", "9"), s * 10 + digit(c)).otherwise(s * 100 + digit(c)) % 97)


def _valid_card(digits: Column) -> Column:
    issuer = digits.rlike(r"^(?:4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[4-9]|6(?:011|4[4-9]|5|2))") & F.char_length(digits).between(13, 19)
    return issuer & (_luhn(digits) % 10 == 0)


def _cards(text: Column) -> Column:
    """All valid cards from any group of digits to the end of any other, as they are written."""
    subs = lambda w: F.array(*(F.regexp_extract(w, rf"^\d(?:[ -]?\d){{{n - 1}}}(?!\d)", 0) for n in range(19, 12, -1)))
    return F.filter(F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(CARD_WINDOW), F.lit(1)), subs))), lambda c: _valid_card(_digits(c)))


def _ibans(text: Column) -> Column:
    """All valid IBANs of their country's length, as they are written."""
    lengths = F.create_map(*(F.lit(x) for c, n in IBAN_LENGTHS.items() for x in (c, n)))

    def subs(w):
        known = F.try_element_at(lengths, F.substring(w, 1, 2))
        of = F.when(known.isNotNull(), F.array(known)).otherwise(F.sequence(F.lit(34), F.lit(15), F.lit(-1)))
        return F.transform(of, lambda n: F.coalesce(F.regexp_substr(w, F.concat(F.lit("^(?: ?[A-Z0-9]){"), n.cast("string"), F.lit("}(?![A-Z0-9])"))), F.lit("")))

    found = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(IBAN_WINDOW), F.lit(1)), subs)))
    return F.filter(found, lambda x: (x != "") & (_remainder97(F.regexp_replace(x, " ", "")) == 1))


def _any_of(before: str, values: Column) -> Column:
    """A pattern for any of ``values``, the longest first; of no value, one that never fits."""
    longest = F.transform(F.sort_array(F.transform(values, lambda v: F.struct((-F.char_length(v)).alias("n"), v.alias("v")))), lambda x: x["v"])
    return F.when(F.size(values) > 0, F.concat(F.lit(f"{before}(?:"), F.array_join(longest, "|"), F.lit(f"){AFTER}"))).otherwise(F.lit("(?!)"))


def _cut(segments: Column, pattern: Column) -> Column:
    """Segments ``(s, found)``: those not found yet are cut at the matches of ``pattern``."""
    mark = lambda found: lambda s: F.struct(s.alias("s"), F.lit(found).alias("found"))

    def cut(x):
        parts, found = F.transform(F.split(x["s"], pattern, -1), mark(False)), F.transform(F.regexp_extract_all(x["s"], pattern, F.lit(0)), mark(True))
        return F.when(x["found"], F.array(x)).otherwise(F.flatten(F.zip_with(parts, found, lambda p, f: F.when(f.isNull(), F.array(p)).otherwise(F.array(p, f)))))

    return F.flatten(F.transform(segments, cut))


def pseudonym(key: str, found: Column) -> Column:
    """The pseudonym of one candidate; the candidate itself where validation fails."""
    at = lambda *names: f"^(?:{'|'.join(f'(?:{KINDS[n]})' for n in names)})$"
    digits = _digits(found)
    n = F.char_length(digits)

    local = F.substring_index(found, "@", 1)
    email = F.concat(permute_text(key + "e", local), F.substring(found, F.char_length(local) + 1, F.char_length(found)))

    bare = F.regexp_replace(found, " ", "")
    account = permute_text(key + "b", F.substring(bare, F.lit(5), F.char_length(bare)))
    check = F.lpad((98 - _remainder97(F.concat(F.substring(bare, 1, 2), F.lit("00"), account))).cast("string"), 2, "0")
    new_bare = F.concat(F.substring(bare, 1, 2), check, account)
    iban = F.array_join(F.zip_with(F.split(found, "[A-Z0-9]", -1), F.concat(F.split(new_bare, ""), F.array(F.lit(""))), lambda g, d: F.concat(g, F.coalesce(d, F.lit("")))), "")

    issuer = F.when(digits.startswith("4"), 1).otherwise(4)
    body = F.concat(F.substring(digits, F.lit(1), issuer), permute_text(key + "c", F.substring(digits, issuer + 1, n - issuer - 1)))
    card = _refill(found, F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")))

    code = F.when(found.startswith("+"), F.char_length(F.regexp_extract(digits, COUNTRY_CODE, 0))).otherwise(0)
    national = F.substring(digits, code + 1, n)
    american = (F.char_length(national) == 10) & ((code == 0) | (F.substring(digits, F.lit(1), code) == "1"))
    kind = lambda at: F.when(national.substr(at, 1) >= "2", 2).otherwise(0)
    size = lambda at: F.when(national.substr(at, 1) >= "2", 8).otherwise(2)
    pair = permute_pair(
        key + "p", national.substr(1, 3).cast("int") - kind(1) * 100, national.substr(4, 7).cast("int") - kind(4) * 1_000_000, size(1) * 100, size(4) * 1_000_000
    )
    padded = lambda x, size: F.lpad(x.cast("string"), size, "0")
    moved_american = F.aggregate(F.array(pair), F.lit(""), lambda _, m: F.concat(padded(m["l"] + kind(1) * 100, 3), padded(m["r"] + kind(4) * 1_000_000, 7)))
    elsewhere = F.concat(F.substring(national, 1, 1), permute_text(key + "p", F.substring(national, F.lit(2), n)))
    phone = _refill(found, F.concat(F.substring(digits, F.lit(1), code), F.when(american, moved_american).otherwise(elsewhere)))

    octet = lambda i: F.split_part(found, F.lit("."), F.lit(i)).cast("int")
    moved = permute_pair(key + "i", octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), 65536, 65536)
    byte = lambda half: F.concat(F.floor(half / 256).cast("string"), F.lit("."), (half % 256).cast("string"))
    ip = F.aggregate(F.array(moved), F.lit(""), lambda _, m: F.concat(byte(m["l"]), F.lit("."), byte(m["r"])))
    valid_ip = (octet(1) < 256) & (octet(2) < 256) & (octet(3) < 256) & (octet(4) < 256)

    part = lambda at, size: found.substr(at, size)
    of = lambda y, m, d: F.datediff(F.concat_ws("-", y, m, d).try_cast("date"), F.lit("1900-01-01").cast("date"))
    slash, dot = found.contains("/"), found.contains(".")
    month_first = of(part(7, 4), part(1, 2), part(4, 2))
    day = F.when(slash, F.coalesce(month_first, of(part(7, 4), part(4, 2), part(1, 2)))).when(dot, of(part(7, 4), part(4, 2), part(1, 2))).otherwise(of(part(1, 4), part(6, 2), part(9, 2)))
    a, b = DAYS
    date_of = lambda x: F.date_add(F.lit("1900-01-01").cast("date"), x.cast("int"))
    permuted = lambda x: F.aggregate(F.array(permute_pair(key + "d", F.floor(x / b), x % b, a, b)), F.lit(0).cast("long"), lambda _, m: m["l"] * b + m["r"])
    # day first: on along the permutation's cycle until the day of the month is no month's number again; each step fails with 0.4
    walked = F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), day.cast("long"), lambda x, i: F.when((i > 0) & (F.dayofmonth(date_of(x)) > 12), x).otherwise(permuted(x)))
    new_day = date_of(F.when(slash & month_first.isNull(), walked).otherwise(permuted(day.cast("long"))))
    shape = F.when(slash & month_first.isNull(), F.date_format(new_day, "dd/MM/yyyy")).when(slash, F.date_format(new_day, "MM/dd/yyyy")).when(dot, F.date_format(new_day, "dd.MM.yyyy"))
    date = F.coalesce(shape, F.date_format(new_day, "yyyy-MM-dd"))

    serial = permute_pair(key + "s", digits.substr(4, 2).cast("int") - 1, digits.substr(6, 4).cast("int") - 1, 99, 9999)
    ssn = F.aggregate(F.array(serial), F.lit(""), lambda _, m: F.concat(F.substring(digits, 1, 3), F.lit("-"), padded(m["l"] + 1, 2), F.lit("-"), padded(m["r"] + 1, 4)))
    valid_ssn = ~digits.rlike("^(?:000|666|9)") & (digits.substr(4, 2) != "00") & (digits.substr(6, 4) != "0000")

    return (
        F.when(found.contains("@"), email)
        .when(found.rlike(at("iban")) & (F.char_length(bare) >= 15), F.when(_remainder97(bare) == 1, iban).otherwise(found))
        .when(found.rlike(at("date")), F.when(day.between(0, a * b - 1), date).otherwise(found))
        .when(found.rlike(at("ssn")), F.when(valid_ssn, ssn).otherwise(found))
        .when(found.rlike(at("ip")), F.when(valid_ip, ip).otherwise(found))
        .when(found.rlike(at("phone")), phone)
        .when(found.rlike(at("card")), F.when(_valid_card(digits), card).otherwise(found))
        .otherwise(found)
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; with ``found``, a column of that name has the number of values replaced."""
    usual = lambda wanted: F.filter("__cards", lambda c: c.rlike(USUAL_CARD) == wanted)
    out = docs.withColumns({"__cards": _cards(F.col(text)), "__ibans": _ibans(F.col(text))})
    first = F.concat_ws("|", F.lit(f"(?:{KINDS['email']})"), _any_of(BEFORE_IBAN, F.col("__ibans")), _any_of(BEFORE_CARD, usual(True)))
    out = out.withColumns({"__first": first, "__second": _any_of(BEFORE_CARD, usual(False))})
    whole = F.array(F.struct(F.col(text).alias("s"), F.lit(False).alias("found")))
    out = out.withColumn("__segments", _cut(whole, F.col("__first")))
    out = out.withColumn("__segments", F.when(F.col("__second") == "(?!)", F.col("__segments")).otherwise(_cut(F.col("__segments"), F.col("__second"))))
    out = out.withColumn("__segments", _cut(F.col("__segments"), F.lit(OTHERS)))
    out = out.withColumn("__new", F.when(F.size("__segments") > 1, F.transform("__segments", lambda x: F.when(x["found"], pseudonym(key, x["s"])).otherwise(x["s"]))))
    if found:
        changed = F.size(F.filter(F.zip_with("__segments", "__new", lambda x, y: x["s"] != y), lambda x: x))
        out = out.withColumn(found, F.when(F.size("__segments") > 1, changed).otherwise(0))
    return out.withColumn(text, F.when(F.size("__segments") > 1, F.array_join("__new", "")).otherwise(F.col(text))).drop("__cards", "__ibans", "__first", "__second", "__segments", "__new")
