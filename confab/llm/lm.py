"""A hierarchical Pitman-Yor bigram model, sampled by Gibbs sweeps over the whole corpus.

Each context, the previous word, is a restaurant; all of them share one parent
restaurant over words, whose base is uniform over the vocabulary and one unknown word. A dish's customers in a restaurant
sit at tables; each table is a customer of the parent. In a sweep, customers are taken from their tables one at a time and seated anew,
by the Chinese-restaurant rule given all others of the dish as they sit then: at a table in proportion to its customers less the discount, or at a new one in proportion to
(concentration + discount * tables) * parent's probability. Every customer of every dish moves once in a sweep. A dish of at most GROUPS customers moves them one by one; a larger one
in GROUPS groups of customers of all its tables, each of whom chooses given all others as they sat when the group began. The parent's customers are moved likewise after their number has followed the tables below. What other dishes contribute (a context's other tables, the
parent's totals) is as the sweep before left it, so that all dishes of the corpus can move at once. The seating that sampling starts from
is made by the same rule in one pass, for dishes of more than GROUPS customers in growing groups. Predictive probabilities are averaged over
the last two sweeps.

Layout: tokens are sent once, as packed arrays by (bucket of word, slice of documents), to the bucket that owns the word.
There a word's counts, its contexts and its place in the parent restaurant are local. What crosses buckets are the tables of each
context: a bucket sends its own by parts of all contexts, a part adds them up and sends the totals back in the order of each
bucket's contexts. Buckets and their parts are written as bucketed tables, so a sweep moves these sums and the seatings alone. A word, or pair of
word and context, that alone would fill a quarter of a bucket is hot: its pairs, or its documents, are dealt to all buckets and its sums are put together on the
driver, which so gets a few rows for each bucket at most (a corpus of n buckets has at most 5.4 n hot words and as many hot pairs). Last, each bucket turns its postings into sums by document.

Counts cover all training documents, texts are read whole, and buckets grow in number, not in size. Words are told apart by 64-bit numbers.

Edge cases: a null or empty text has the end token alone; very long texts are read whole, in pieces. Words outside the training part get the parent's share for the
unknown. Without training documents all probabilities are those of the base. Null ids count as training or held out by the
crc32 of the empty text. Repeated rows are scored each, and alike; order and ties play no part. An empty table gives no rows. Other columns, of whatever names, take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confab.llm.common import by_size, discard, kept, mix, release, scratch, store, store_bucketed, with_row_id, word_numbers

#: Tokens of a bucket, about; bytes of text that are packed at a time; documents whose sums a worker holds before it sends them.
BUCKET_TOKENS, SLICE_BYTES, HELD_ROWS = 850_000, 6 << 20, 300_000
SWEEPS, AVERAGED = 3, 2
#: A word or pair with at least 1/HOT of a bucket's tokens is hot; slices report those with a quarter of that share.
HOT = 4
#: Most bucket files of a table.
FILES = 10_000
#: Documents whose sums travel together.
DOCS = 64
#: Concentrations of the context restaurants and of the parent.
THETA, THETA0 = 1.0, 1.0
#: Groups in which a dish's customers move in a sweep; up to so many customers are seated one by one at the start, more of them in groups of a sixteenth of those seated.
GROUPS = 64

_END, _START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_SALT = np.uint64(0xA24BAED4963EE407)


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (with an end token for each text), contexts, and the text's number of each token."""
    words, counts = word_numbers(texts)
    sizes = counts + 1
    ends = np.cumsum(sizes)
    w = np.full(int(ends[-1]), _END)
    inner = np.ones(len(w), bool)
    inner[ends - 1] = False
    w[inner] = words
    before = np.empty_like(w)
    before[1:] = w[:-1]
    before[ends - sizes] = _START
    return w, before, np.repeat(np.arange(len(texts), dtype=np.int64), sizes)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of rows whose numbers follow one another."""
    rid = batch.column(0).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(rid) != 1) + 1).tolist(), len(rid)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield from by_size(batch.slice(a, b - a), "text", SLICE_BYTES)


def _pair(w: np.ndarray, k: np.ndarray) -> np.ndarray:
    return mix(w ^ mix(k + _SALT))


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order, and the place of each element among them. Only the distinct ones are sorted."""
    code, names = pd.factorize(x)
    order = np.argsort(names)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return names[order], rank[code]


def among(x: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Which elements are in ``few``."""
    if not len(few):
        return np.zeros(len(x), bool)
    few = np.sort(few)
    return few[np.minimum(np.searchsorted(few, x), len(few) - 1)] == x


def stable_order(key: np.ndarray, most: int) -> np.ndarray:
    """The order of numbers from 0 to ``most``, equal ones as they stand: each with its place makes one number to sort, if 64 bits hold both."""
    if most < 1 << 16:
        return np.argsort(key.astype(np.uint16), kind="stable")
    bits = len(key).bit_length()
    if most.bit_length() + bits > 64:
        return np.argsort(key, kind="stable")
    both = np.sort((key.astype(np.uint64) << np.uint64(bits)) | np.arange(len(key), dtype=np.uint64))
    return (both & np.uint64((1 << bits) - 1)).astype(np.int64)


def counted(at: np.ndarray, k: np.ndarray, doc: np.ndarray, names: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (word, context, document) in order, and how often each occurs; words and contexts are below ``names``, documents below 2**16."""
    bits = names.bit_length()
    if 2 * bits + 16 > 64:
        order = np.lexsort((doc, k, at))
        at, k, doc = at[order], k[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (k[1:] != k[:-1]) | (doc[1:] != doc[:-1])]))
        return at[first], k[first], doc[first].astype(np.uint16), np.diff(np.append(first, len(at)))
    key = np.sort((((at.astype(np.uint64) << np.uint64(bits)) | k.astype(np.uint64)) << np.uint64(16)) | doc.astype(np.uint64))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n, key = np.diff(np.append(first, len(key))), key[first]
    pair = key >> np.uint64(16)
    return (pair >> np.uint64(bits)).astype(np.int64), (pair & np.uint64((1 << bits) - 1)).astype(np.int64), key.astype(np.uint16), n


def _packed(x: np.ndarray) -> bytes:
    """The differences of an array, first bytes first, compressed: most arrays here rise in long runs."""
    d = np.ascontiguousarray(x).reshape(-1).view(f"u{x.itemsize}").copy()
    d[1:] -= d[:-1].copy()
    raw, each = np.empty((x.itemsize, len(d)), np.uint8), d.view(np.uint8).reshape(-1, x.itemsize)
    for i in range(x.itemsize):
        raw[i] = each[:, i]
    return raw.nbytes.to_bytes(8, "little") + pa.compress(raw.reshape(-1).data, "zstd", asbytes=True)


def _unpacked(x: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(x[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    raw, each = np.frombuffer(pa.decompress(x[8:], n, "zstd", asbytes=True), np.uint8).reshape(size, -1), np.empty((n // size, size), np.uint8)
    for i in range(size):
        each[:, i] = raw[i]
    d = each.reshape(-1).view(f"u{size}")
    return np.cumsum(d, dtype=d.dtype).view(kind)


def _frequent(rows: DataFrame, hot: int) -> DataFrame:
    """``(kind, key, n)``: kind 0 the tokens of a slice, 1 words and 2 pairs that are frequent in a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for _, texts in by_size(whole, "text", SLICE_BYTES):
                w, k, _ = _tokens(texts)
                kinds, keys, counts = [np.zeros(1, np.int32)], [np.zeros(1, np.uint64)], [np.array([len(w)])]
                some = np.ones(len(w), bool)
                for kind, of in ((1, lambda w, k: w), (2, _pair)):
                    # a frequent pair has a frequent word
                    at, key = pd.factorize(of(w[some], k[some]))
                    n = np.bincount(at, minlength=len(key))
                    often = n * 4 * hot >= len(w)
                    some[some] = often[at]
                    kinds.append(np.full(often.sum(), kind, np.int32))
                    keys.append(key[often])
                    counts.append(n[often])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds)), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(counts))], names=["kind", "key", "n"])

    return rows.select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


_SENT = "bucket int, rid0 long, held binary, w binary, wn binary, names binary, k binary, doc binary, n binary"


def _sent(rows: DataFrame, buckets: int, hot_words: np.ndarray, hot_pairs: np.ndarray) -> DataFrame:
    """Each slice's tokens, packed by bucket: words, their numbers of entries, and each entry's context, document and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in _slices(whole):
                w, k, doc = _tokens(texts)
                names, at = distinct(np.append(w, _START))
                # a context is the word before or the start
                at, k = at[:-1], np.where(k == _START, at[-1], np.concatenate([at[:1], at[:-2]]))
                at, k, doc, n = counted(at, k, doc, len(names))
                to = (mix(names + _SALT) % np.uint64(buckets))[at]
                hot = among(names, hot_words)[at]
                if hot.any():
                    pair = _pair(names[at[hot]], names[k[hot]])
                    rid0 = np.uint64(batch.column(0)[0].as_py())
                    to[hot] = np.where(among(pair, hot_pairs), mix(pair ^ mix(doc[hot].astype(np.uint64) + rid0)), pair) % np.uint64(buckets)
                order = stable_order(to, buckets - 1)
                to, at, k, doc, n = to[order].astype(np.int32), at[order], k[order].astype(np.int32), doc[order], n[order].astype(np.uint32)
                place = np.empty(len(names), np.uint32)
                cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                held = np.packbits(batch.column(2).to_numpy(zero_copy_only=False).astype(bool)).tobytes()
                out = []
                for a, b in zip(cuts, [*cuts[1:], len(to)], strict=True):
                    first = np.flatnonzero(np.concatenate([[True], at[a + 1 : b] != at[a : b - 1]]))
                    runs = np.diff(np.concatenate([first, [b - a]])).astype(np.uint32)
                    own = np.unique(k[a:b])
                    place[own] = np.arange(len(own))
                    arrays = (names[at[a:b][first]], runs, names[own], place[k[a:b]], doc[a:b], n[a:b])
                    out.append((int(to[a]), batch.column(0)[0].as_py(), held, *map(_packed, arrays)))
                kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 7)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _SENT.split(", ")])

    return rows.select("rid", "text", "held_out").mapInArrow(run, _SENT)


_KINDS = {"words": np.uint64, "contexts": np.uint64, "sizes": np.uint32, "pair_word": np.int32, "pair_context": np.int32, "count": np.uint32, "runs": np.uint32, "rids": np.int64, "doc": np.int32, "n": np.uint32}
_MERGED = "bucket int, " + ", ".join(f"{c} binary" for c in _KINDS)


def _row(part: pd.DataFrame) -> SimpleNamespace:
    """A bucket's arrays."""
    return SimpleNamespace(**{c: int(x.iloc[0]) if c == "bucket" else _unpacked(x.iloc[0], _KINDS[c]) for c, x in part.items()})


def _merged(part: pd.DataFrame, parts: int) -> pd.DataFrame:
    """A bucket's arrays: distinct words; distinct contexts by part, and how many each part has; (word, context) pairs with training counts; postings in the
    order of pairs; the row numbers of the documents in them."""
    w, wn, names, k, doc, n, train, rids, at, before = [], [], [], [], [], [], [], [], 0, 0
    for r in part.sort_values("rid0").itertuples(index=False):
        d = _unpacked(r.doc, np.uint16)
        held = np.unpackbits(np.frombuffer(r.held, np.uint8)).astype(bool)
        here = np.zeros(len(held), bool)
        here[d] = True
        w.append(_unpacked(r.w, np.uint64))
        wn.append(_unpacked(r.wn, np.uint32))
        names.append(_unpacked(r.names, np.uint64))
        k.append(_unpacked(r.k, np.uint32).astype(np.int64) + before)
        before += len(names[-1])
        doc.append((np.cumsum(here) - 1 + at)[d].astype(np.int32))
        n.append(_unpacked(r.n, np.uint32))
        train.append(~held[d])
        rids.append(r.rid0 + np.flatnonzero(here))
        at += len(rids[-1])
    w, wn, names, k, doc, n, train, rids = (np.concatenate(x) for x in (w, wn, names, k, doc, n, train, rids))
    words, word = distinct(w)
    contexts, context = distinct(names)
    to = mix(contexts + _SALT) % np.uint64(parts)
    order = stable_order(to, parts - 1)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    bits = len(contexts).bit_length()
    key = (np.repeat(word, wn) << bits) | rank[context][k]
    del w, names, k, word, context
    order_of_pairs = stable_order(key, len(words) << bits)
    key, doc, n, train = key[order_of_pairs], doc[order_of_pairs], n[order_of_pairs], train[order_of_pairs]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    runs = np.diff(np.concatenate([start, [len(key)]]))
    count = np.add.reduceat(np.where(train, n, 0).astype(np.int64), start)
    pair = key[start]
    arrays = {"words": words, "contexts": contexts[order], "sizes": np.bincount(to.astype(np.int64), minlength=parts), "pair_word": pair >> bits, "pair_context": pair & ((1 << bits) - 1), "count": count, "runs": runs, "rids": rids, "doc": doc, "n": n}
    return pd.DataFrame([{"bucket": int(part.bucket.iloc[0])} | {c: _packed(x.astype(_KINDS[c])) for c, x in arrays.items()}])


def _by_part(x: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, bytes]]:
    ends = np.cumsum(sizes.astype(np.int64))
    for part in np.flatnonzero(sizes):
        yield int(part), _packed(x[ends[part] - sizes[part] : ends[part]])


def _orders(merged: DataFrame) -> DataFrame:
    """``(part, contexts, sizes, at)``: the distinct contexts of a part, and for its buckets in order how many they have, and which."""

    def sent(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in parts:
            for i in range(len(some)):
                row = _row(some.iloc[i : i + 1])
                yield pd.DataFrame([(part, row.bucket, x) for part, x in _by_part(row.contexts, row.sizes)], columns=["part", "bucket", "contexts"])

    def order(part: pd.DataFrame) -> pd.DataFrame:
        own = [_unpacked(x, np.uint64) for x in part.sort_values("bucket").contexts]
        contexts, at = distinct(np.concatenate(own))
        return pd.DataFrame([(part.part.iloc[0], _packed(contexts), _packed(np.array([len(x) for x in own], np.uint32)), _packed(at.astype(np.uint32)))], columns=["part", "contexts", "sizes", "at"])

    rows = merged.select("bucket", "contexts", "sizes").mapInPandas(sent, "part int, bucket int, contexts binary")
    return rows.groupBy("part").applyInPandas(order, "part int, contexts binary, sizes binary, at binary")


#: Totals of a bucket's contexts by part, and as part -1 a bucket's seating: tables of pairs, sizes of the tables of cold pairs with several
#: customers, and of the parent the words' customers, tables and sizes.
_KNOWN = "bucket int, part int, sweep int, customers binary, tables binary, sizes binary, root_tables binary, root_sizes binary"


def _totals(orders: DataFrame, own: DataFrame, sweep: int, wanted: np.ndarray) -> DataFrame:
    """Adds up ``own (part, bucket, customers, tables)`` by context, and gives each bucket the totals of its contexts; as bucket -1 those of ``wanted``."""

    def total(order: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        part, own = int(order.part.iloc[0]), own.sort_values("bucket")
        contexts, at = _unpacked(order.contexts.iloc[0], np.uint64), _unpacked(order["at"].iloc[0], np.uint32)
        cuts = np.cumsum(_unpacked(order.sizes.iloc[0], np.uint32).astype(np.int64))[:-1]
        sums = [np.bincount(at, weights=np.concatenate([_unpacked(x, np.uint32) for x in own[c]]), minlength=len(contexts)).astype(np.uint64) for c in ("customers", "tables")[sweep > 0 :]]
        back = [[_packed(x) for x in np.split(s[at], cuts)] for s in sums]
        here = np.flatnonzero(among(contexts, wanted))
        rows = list(zip(own.bucket, [part] * len(own), [sweep] * len(own), back[0] if sweep == 0 else [None] * len(own), back[-1], strict=True))
        if len(here):
            rows.append((-1, part, sweep, _packed(contexts[here]), _packed(np.stack([sums[0][here], sums[-1][here]]))))
        return pd.DataFrame(rows, columns=["bucket", "part", "sweep", "customers", "tables"])

    return orders.groupBy("part").cogroup(own.groupBy("part")).applyInPandas(total, "bucket int, part int, sweep int, customers binary, tables binary")


def seat(c: np.ndarray, new: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after c customers of each dish have been seated for the first time; ``new``: the weight of a new table, (theta + d * tables) * P(dish)."""
    order = np.argsort(-c, kind="stable")
    c, new, t = c[order], new[order], (c[order] > 0).astype(np.float64)
    i, left = 1, int((c > 1).sum())
    while left:
        p = new[:left] / (new[:left] + np.maximum(i - d * t[:left], 1e-9))
        step = 1 if i < GROUPS else i // 16
        t[:left] += rng.random(left) < p if step == 1 else rng.binomial(np.minimum(step, c[:left] - i), p)
        i += step
        left = int(np.searchsorted(-c, -i, side="left"))
    out = np.empty(len(c), np.int64)
    out[order] = t.astype(np.int64)
    return out


def first_sizes(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Customers of each of t tables, one dish after the other, at the start: the k-th table's share falls as k to the power -1/d."""
    starts = np.cumsum(t) - t
    dish = np.repeat(np.arange(len(t)), t)
    share = (np.arange(len(dish)) - starts[dish] + 1.0) ** (-1 / d)
    some = t > 0
    total = np.zeros(len(t))
    total[some] = np.add.reduceat(share, starts[some]) if some.any() else 0
    sizes = 1 + ((c - t)[dish] * share / total[dish]).astype(np.int64)
    sizes[starts[some]] += (c - np.bincount(dish, weights=sizes, minlength=len(t)).astype(np.int64))[some]
    return sizes


def _nth(a: np.ndarray) -> np.ndarray:
    """Each element's place, from 0, in its run of equal ones."""
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    return np.arange(len(a)) - np.repeat(first, np.diff(np.concatenate([first, [len(a)]])))


#: Of the type of a table's size: numpy takes a plain 1 for a wider one, and converts at every index.
_ONE = np.int32(1)


class Seating:
    """The tables of many dishes, and which customer sits where, as flat arrays: a dish has ``room`` places from ``at`` on in each."""

    def __init__(self, n: np.ndarray, t: np.ndarray, sizes: np.ndarray, room: np.ndarray, d: float, rng: np.random.Generator):
        self.n, self.t, self.d, self.rng = n.astype(np.int64), t.astype(np.int64), d, rng
        self.at = np.cumsum(room) - room
        self.table, self.size, self.free = (np.zeros(int(room.sum()), np.int32) for _ in range(3))
        within = lambda k: np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        nth = within(self.t)
        self.size[np.repeat(self.at, self.t) + nth] = sizes
        self.table[np.repeat(self.at, self.n) + within(self.n)] = np.repeat(nth, sizes)
        self.unused = room - self.t
        self.free[np.repeat(self.at, self.unused) + within(self.unused)] = np.repeat(self.t, self.unused) + within(self.unused)

    def remove(self, a: np.ndarray) -> None:
        """One customer, any with the same chance, leaves each dish of ``a``."""
        i = self.at[a] + (self.rng.random(len(a)) * self.n[a]).astype(np.int64)
        k, last = self.table[i], self.at[a] + self.n[a] - 1
        self.table[i] = self.table[last]
        self.n[a] -= 1
        self.size[self.at[a] + k] -= 1
        self._clear(a, k)

    def _clear(self, a: np.ndarray, k: np.ndarray) -> None:
        """Tables ``k`` of dishes ``a``, which customers have left, are free if nobody sits there."""
        empty = self.size[self.at[a] + k] == 0
        place, first = np.unique((self.at[a] + k)[empty], return_index=True)
        e = a[empty][first]
        self.free[self.at[e] + self.unused[e] + _nth(e)] = place - self.at[e]
        np.subtract.at(self.t, e, 1)
        np.add.at(self.unused, e, 1)

    def _open(self, e: np.ndarray) -> np.ndarray:
        """A free table for each of ``e``, in which a dish's customers follow one another."""
        k = self.free[self.at[e] + self.unused[e] - 1 - _nth(e)]
        np.subtract.at(self.unused, e, 1)
        np.add.at(self.t, e, 1)
        return k

    def leave(self, times: np.ndarray) -> None:
        """So many random customers leave each dish."""
        some = np.flatnonzero(times)
        a = np.repeat(some, self.n[some])
        place = self.at[a] + _nth(a)
        self.table[place] = self.table[place[np.argsort(a + self.rng.random(len(a)), kind="stable")]]
        a = np.repeat(some, times[some])
        k = self.table[self.at[a] + self.n[a] - 1 - _nth(a)]
        self.n -= times
        np.subtract.at(self.size, self.at[a] + k, _ONE)
        self._clear(a, k)

    def come(self, times: np.ndarray, weight: Callable[[np.ndarray], np.ndarray]) -> None:
        """So many customers of each dish sit down, one by one where at most GROUPS sit, else in groups of a sixteenth of those who sit."""
        left = times.astype(np.int64)
        some = np.flatnonzero(left)
        while len(some):
            step = np.minimum(left[some], np.where(self.n[some] > GROUPS, self.n[some] // 16, 1))
            a = np.repeat(some, step)
            self.add(a, weight(a))
            left[some] -= step
            some = some[left[some] > 0]

    def sweep(self, weight: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        """Every customer moves once; ``weight``: of a new table, given the dishes and the tables of their other customers."""
        order = np.argsort(-self.n, kind="stable")
        n = self.n[order]
        for j in range(min(GROUPS, int(n.max(initial=0)))):  # every GROUPS-th customer from j on: neighbours of a table move in different groups
            some = int(np.searchsorted(-n, -j, side="left"))
            a = np.repeat(order[:some], (n[:some] - j - 1) // GROUPS + 1)
            self._move(a, j + GROUPS * _nth(a), weight)

    def _move(self, a: np.ndarray, i: np.ndarray, weight: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        """Customers ``i`` of dishes ``a``, in which a dish's follow one another, choose anew, each given all others as they sit now."""
        at, others = self.at[a], self.n[a] - 1
        k = self.table[at + i]
        tables = self.t[a] - (self.size[at + k] == 1)
        new = weight(a, tables)
        alone = self.rng.random(len(a)) * (others - self.d * tables + new) < new
        alone |= others == 0
        to, todo = np.empty(len(a), np.int32), np.flatnonzero(~alone)
        while len(todo):  # beside another customer taken at random, which holds with probability (size - d) / size
            r = (self.rng.random(len(todo)) * others[todo]).astype(np.int64)
            x = self.table[at[todo] + r + (r >= i[todo])]
            size = self.size[at[todo] + x] - (x == k[todo])
            holds = self.rng.random(len(todo)) * size >= self.d
            to[todo[holds]] = x[holds]
            todo = todo[~holds]
        np.subtract.at(self.size, at + k, _ONE)
        np.add.at(self.size, (at + to)[~alone], _ONE)
        self._clear(a, k)
        to[alone] = self._open(a[alone])
        self.size[(at + to)[alone]] = 1
        self.table[at + i] = to

    def add(self, a: np.ndarray, weight: np.ndarray) -> None:
        """Customers of the dishes ``a``, in which a dish's follow one another, sit down, each given those who sit now; ``weight``: that of a new table."""
        alone = self.rng.random(len(a)) * (self.n[a] - self.d * self.t[a] + weight) < weight
        alone |= self.n[a] == 0
        k, todo = np.empty(len(a), np.int32), np.flatnonzero(~alone)
        while len(todo):  # beside a customer taken at random, which holds with probability (size - d) / size
            b = a[todo]
            x = self.table[self.at[b] + (self.rng.random(len(b)) * self.n[b]).astype(np.int64)]
            holds = self.rng.random(len(b)) * self.size[self.at[b] + x] >= self.d
            k[todo[holds]] = x[holds]
            todo = todo[~holds]
        k[alone] = self._open(a[alone])
        np.add.at(self.size, self.at[a] + k, _ONE)
        self.table[self.at[a] + self.n[a] + _nth(a)] = k
        np.add.at(self.n, a, 1)

    def steps(self, times: np.ndarray, step: Callable[[np.ndarray], None]) -> None:
        """``step`` for each dish so many times."""
        order = np.argsort(-times, kind="stable")
        falling = -times[order]
        for j in range(int(times.max(initial=0))):
            step(order[: int(np.searchsorted(falling, -j, side="left"))])

    def sizes(self) -> np.ndarray:
        return self.size[self.size > 0]


class Dish:
    """One dish with many customers: the sizes of its tables."""

    def __init__(self, sizes: np.ndarray, d: float, rng: np.random.Generator):
        self.sizes, self.d, self.rng = np.asarray(sizes, np.int64), d, rng

    def remove(self, n: int) -> None:
        left = self.sizes - self.rng.multivariate_hypergeometric(self.sizes, n, method="marginals")
        self.sizes = left[left > 0]

    def add(self, n: int, weight: Callable[[int], float]) -> None:
        """n customers sit down, in groups of at most a sixteenth of those who sit."""
        while n:
            have = int(self.sizes.sum())
            some = max(1, min(n, have // 16))
            old, new = have - self.d * len(self.sizes), weight(len(self.sizes))
            alone = int(self.rng.binomial(some, new / (new + old))) if have else some
            if some > alone:
                self.sizes = self.sizes + self.rng.multinomial(some - alone, (self.sizes - self.d) / old)
            self.sizes = np.concatenate([self.sizes, np.ones(alone, np.int64)])
            n -= some

    def move(self, times: int, weight: Callable[[int], float]) -> None:
        """So many customers move, all of them once before any moves again, in at most GROUPS groups a round, each of which chooses given all as they sat when it began."""
        left = int(times)
        while left:
            have = int(self.sizes.sum())
            todo, some = self.sizes.copy(), min(left, have)
            for n in np.diff(np.arange(GROUPS + 1) * some // GROUPS).tolist() if some > GROUPS else [1] * some:
                gone = self.rng.multivariate_hypergeometric(todo, n, method="marginals")
                rest = self.sizes - gone if n == 1 else self.sizes
                t, others, new = np.count_nonzero(rest), have - 1, weight(np.count_nonzero(rest))
                alone = n if not others else int(self.rng.binomial(n, new / (new + others - self.d * t)))
                share = np.where(rest > 0, rest - self.d, 0)
                joined = self.rng.multinomial(n - alone, share / share.sum()) if n > alone else 0
                after = self.sizes - gone + joined
                stay = after > 0
                self.sizes = np.concatenate([after[stay], np.ones(alone, np.int64)])
                todo = np.concatenate([(todo - gone)[stay], np.zeros(alone, np.int64)])
            left -= some


class Sums:
    """What reaches the driver after a sweep: root totals, the hot words' and pairs' sums, and the totals of the hot pairs' contexts."""

    def __init__(self):
        self.tokens = 0.0
        self.contexts: dict[int, float] = {}  # tables of the hot pairs' contexts over all pairs
        self.added: dict[int, list[float]] = {}  # customers and tables that the hot pairs add to their contexts
        self.hot_words: dict[int, list[float]] = {}  # key: training count, customers at the root, tables at the root
        self.hot_pairs: dict[int, list[float]] = {}  # key: training count, tables, context
        self.sizes: dict[tuple[int, int], np.ndarray] = {}  # (1, word) at the root and (2, pair): the sizes of the tables
        self.root_customers = self.root_tables = self.vocabulary = 0.0
        self.ones, self.twos, self.root_ones, self.root_twos = 0.0, 0.0, 0.0, 0.0

    def discounts(self) -> tuple[float, float]:
        of = lambda a, b: min(max(a / (a + 2 * b), 0.05), 0.95) if a + b else 0.5
        return of(self.ones, self.twos), of(self.root_ones, self.root_twos)

    def root(self, customers: np.ndarray, tables: np.ndarray, d0: float, moved: np.ndarray | float = 0.0) -> np.ndarray:
        """The parent's probability of words with so many customers and tables there; ``moved``: customers of the word that have come since."""
        base = 1 / (self.vocabulary + 1)
        return (np.maximum(customers + moved - d0 * tables, 0) + (THETA0 + d0 * self.root_tables) * base) / (THETA0 + self.root_customers + moved)

    def root_weight(self, tables: np.ndarray | float, d0: float) -> np.ndarray | float:
        """The weight of a new table at the root; ``tables``: that have come there since."""
        return (THETA0 + d0 * (self.root_tables + tables)) / (self.vocabulary + 1)


class Bucket:
    """One bucket's pairs, and the moves of its dishes."""

    def __init__(self, row, hot_words: np.ndarray, hot_pairs: np.ndarray):
        self.id = int(row.bucket)
        self.words, self.word, self.k, self.own = row.words, row.pair_word, row.pair_context, row.count.astype(np.int64)
        self.contexts, self.sizes = row.contexts, row.sizes
        self.hot_word = among(self.words, hot_words)
        at = np.flatnonzero(self.hot_word[self.word])
        pair = _pair(self.words[self.word[at]], self.contexts[self.k[at]])
        some = among(pair, hot_pairs)
        self.hot_at, self.hot_keys, self.hot_pair = at[some], pair[some], np.zeros(len(self.k), bool)
        self.hot_pair[self.hot_at] = True
        self.hot_words_at = np.flatnonzero(self.hot_word)
        self.many = np.flatnonzero((self.own > 1) & ~self.hot_pair)

    def by_context(self, known: pd.DataFrame, sweep: int, column: str, sums: Sums) -> np.ndarray:
        """The contexts' totals of customers or tables after a sweep, with what the hot pairs add (``sums``, of that sweep)."""
        rows = known[(known.sweep == sweep) & (known.part >= 0)].sort_values("part")
        x = np.concatenate([_unpacked(v, np.uint64) for v in rows[column]]).astype(np.float64)
        added = np.array(list(sums.added), np.uint64)
        order, at = np.argsort(added), np.flatnonzero(among(self.contexts, added))
        if len(at):
            x[at] += np.array([v[column == "tables"] for v in sums.added.values()])[order][np.searchsorted(added[order], self.contexts[at])]
        return x

    @staticmethod
    def seating(known: pd.DataFrame, sweep: int) -> SimpleNamespace:
        row = known[(known.sweep == sweep) & (known.part < 0)].iloc[0]
        return SimpleNamespace(**{c: _unpacked(row[c], np.uint32).astype(np.int64) for c in ("tables", "sizes", "customers", "root_tables", "root_sizes")})

    def with_hot(self, s: SimpleNamespace, sums: Sums) -> tuple[np.ndarray, np.ndarray]:
        """The words' customers and tables at the root, hot ones over all buckets."""
        customers, tables = s.customers.astype(np.float64), s.root_tables.astype(np.float64)
        for i in self.hot_words_at:
            _, customers[i], tables[i] = sums.hot_words[int(self.words[i])]
        return customers, tables

    def swept(self, sweep: int, last: Sums | None, known: pd.DataFrame, discounts: tuple[float, float]) -> SimpleNamespace:
        """The seating after one more sweep; hot pairs and words have no tables here."""
        d, d0 = discounts
        rng = np.random.default_rng([self.id, sweep])
        s = SimpleNamespace(tables=((self.own > 0) & ~self.hot_pair).astype(np.int64), sizes=self.own[self.many])
        many, before = self.many, None
        if sweep:
            before = self.seating(known, sweep - 1)
            context_tables = self.by_context(known, sweep - 1, "tables", last)[self.k[many]]
            customers, root_tables = (x[self.word[many]] for x in self.with_hot(before, last))
        if sweep == 1:
            s.tables[many] = seat(self.own[many], (THETA + d * context_tables) * last.root(customers, root_tables, d0), d, rng)
            s.sizes = first_sizes(self.own[many], s.tables[many], d)
        elif sweep:
            dishes, were = Seating(self.own[many], before.tables[many], before.sizes, self.own[many], d, rng), before.tables[many]

            def weight(a: np.ndarray, tables: np.ndarray) -> np.ndarray:
                moved = tables - were[a]
                return (THETA + d * (context_tables[a] + moved)) * last.root(customers[a], root_tables[a], d0, moved)

            dishes.sweep(weight)
            s.tables[many], s.sizes = dishes.t, dishes.sizes()
        s.customers = np.bincount(self.word, weights=s.tables, minlength=len(self.words)).astype(np.int64)
        self.at_root(s, before, sweep, last, d0, rng)
        return s

    def at_root(self, s: SimpleNamespace, before: SimpleNamespace | None, sweep: int, last: Sums | None, d0: float, rng: np.random.Generator) -> None:
        n = np.where(self.hot_word, 0, s.customers)
        if sweep < 2:
            s.root_tables = (n > 0).astype(np.int64) if last is None else seat(n, np.full(len(n), last.root_weight(0, d0)), d0, rng)
            s.root_sizes = first_sizes(n, s.root_tables, d0)
            return
        n0, t0 = np.where(self.hot_word, 0, before.customers), before.root_tables
        dishes = Seating(n0, t0, before.root_sizes, np.maximum(n, n0), d0, rng)
        weight = lambda a, tables: last.root_weight(tables - t0[a], d0)
        dishes.leave(np.maximum(n0 - n, 0))
        dishes.come(np.maximum(n - n0, 0), lambda a: weight(a, dishes.t[a]))
        dishes.sweep(weight)
        s.root_tables, s.root_sizes = dishes.t, dishes.sizes()


def _hot_sweep(s: Sums, last: Sums | None, sweep: int, discounts: tuple[float, float], word_of: dict[int, int]) -> None:
    """The sweep of the hot pairs and of the hot words at the root, on the driver."""
    (d, d0), rng = discounts, np.random.default_rng([sweep, 11])

    def after(key: tuple[int, int], n: int, d: float, weight: Callable[[int], float]) -> int:
        """Tables of a dish with n customers; ``weight``: of a new table, if the dish has so many."""
        if sweep < 2:
            t = seat(np.array([n]), np.array([weight(1)]), d, rng) if sweep else np.array([min(n, 1)])
            s.sizes[key] = first_sizes(np.array([n]), t, d)
        else:
            dish = Dish(last.sizes[key], d, rng)
            have = int(dish.sizes.sum())
            dish.remove(max(0, have - n))
            dish.add(max(0, n - have), weight)
            dish.move(n, weight)
            s.sizes[key] = dish.sizes
        return len(s.sizes[key])

    for key, pair in s.hot_pairs.items():
        n, _, k = pair
        w = word_of[key]
        if last:
            were = last.hot_pairs[key][1]
            of = lambda t, were=were, w=w, k=k: (THETA + d * (last.contexts[k] + t - were)) * float(last.root(np.array([last.hot_words[w][1]]), np.array([last.hot_words[w][2]]), d0, t - were)[0])
        pair[1] = after((2, key), int(n), d, of if last else float)
        added = s.added.setdefault(k, [0.0, 0.0])
        added[0] += n
        added[1] += pair[1]
        s.contexts[k] += pair[1]
        s.hot_words[w][1] += pair[1]
    for w, x in s.hot_words.items():
        x[2] = after((1, w), int(x[1]), d0, (lambda t, w=w: last.root_weight(t - last.hot_words[w][2], d0)) if last else float)
        s.root_customers += x[1]
        s.root_tables += x[2]


def _sweep(merged: DataFrame, orders: DataFrame, known: DataFrame, sums: list[Sums], discounts: tuple[float, float], hot_words: np.ndarray, hot_pairs: np.ndarray) -> tuple[Sums, DataFrame, list[DataFrame]]:
    """Runs one more sweep over all buckets and puts its sums together; ``known`` and the result are tables of _KNOWN. Last, the stored tables that the result reads.
    Reaches the driver: a row for each hot word, hot pair and hot pair's context."""
    sweep, last = len(sums), sums[-1] if sums else None
    columns = ["kind", "key", "a", "b", "c", "bucket", "customers", "tables", "sizes", "root_tables", "root_sizes"]

    def run(row: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        b = Bucket(_row(row), hot_words, hot_pairs)
        s = b.swept(sweep, last, known, discounts)
        cold, mine = ~b.hot_pair, ~b.hot_word
        count = np.bincount(b.word, weights=b.own, minlength=len(b.words))
        ones = [s.customers[mine].sum(), s.root_tables.sum(), (count[mine] > 0).sum(), (b.own[cold] == 1).sum(), (b.own[cold] == 2).sum(), (s.customers[mine] == 1).sum(), (s.customers[mine] == 2).sum(), b.own.sum()]
        out = [(1, int(b.words[i].view(np.int64)), float(count[i]), float(s.customers[i]), 0) for i in b.hot_words_at]
        out += [(2, int(key.view(np.int64)), float(b.own[i]), 0.0, int(b.contexts[b.k[i]].view(np.int64))) for i, key in zip(b.hot_at, b.hot_keys, strict=True)]
        out += [(3, i, float(x), 0.0, 0) for i, x in enumerate(ones)]
        out = [(*x, b.id, None, None, None, None, None) for x in out]
        by_context = lambda x: _by_part(np.bincount(b.k[cold], weights=x[cold], minlength=len(b.contexts)).astype(np.uint32), b.sizes)
        guests = by_context(b.own) if sweep == 0 else ((None, None) for _ in iter(int, 1))
        out += [(4, part, 0.0, 0.0, 0, b.id, c, t, None, None, None) for (part, t), (_, c) in zip(by_context(s.tables), guests, strict=False)]
        out.append((5, -1, 0.0, 0.0, 0, b.id, *(_packed(x.astype(np.uint32)) for x in (s.customers, s.tables, s.sizes, s.root_tables, s.root_sizes))))
        return pd.DataFrame(out, columns=columns)

    rows = merged.select("bucket", "words", "contexts", "sizes", "pair_word", "pair_context", "count")
    swept = rows.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInPandas(run, "kind int, key long, a double, b double, c long, bucket int, customers binary, tables binary, sizes binary, root_tables binary, root_sizes binary")
    swept = store(swept, "swept")
    found = swept.filter("kind < 4").groupBy("kind", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("c").alias("c")).toPandas()
    own = swept.filter("kind = 4").select(F.col("key").cast("int").alias("part"), "bucket", "customers", "tables")
    wanted = np.unique(found[found.kind == 2].c.to_numpy(np.int64).view(np.uint64))
    crossed = store(_totals(orders, own, sweep, wanted), "totals")
    s, unsigned = Sums(), lambda x: int(x) & 0xFFFFFFFFFFFFFFFF
    s.hot_words = {unsigned(r.key): [r.a, r.b, 0.0] for r in found[found.kind == 1].itertuples()}
    total = found[found.kind == 3].set_index("key").a
    s.root_customers, s.root_tables, s.vocabulary, s.ones, s.twos, s.root_ones, s.root_twos, s.tokens = (float(total.get(i, 0)) for i in range(8))
    for r in crossed.filter("bucket = -1").collect():
        s.contexts |= dict(zip(_unpacked(r.customers, np.uint64).tolist(), _unpacked(r.tables, np.uint64).reshape(2, -1)[1].astype(float).tolist(), strict=True))
    s.vocabulary += sum(x[0] > 0 for x in s.hot_words.values())
    words = np.array(list(s.hot_words), np.uint64)
    word_of = {int(x): int(w) for c in wanted for x, w in zip(_pair(words, np.full(len(words), c, np.uint64)), words, strict=True)}
    s.hot_pairs = {unsigned(r.key): [r.a, 0.0, unsigned(r.c)] for r in found[found.kind == 2].itertuples()}
    _hot_sweep(s, last, sweep, discounts, word_of)
    state = swept.filter("kind = 5").select("bucket", F.lit(-1).alias("part"), F.lit(sweep).alias("sweep"), "customers", "tables", "sizes", "root_tables", "root_sizes")
    return s, crossed.filter("bucket >= 0").unionByName(state, allowMissingColumns=True), [swept, crossed]


def score(docs: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id", sweeps: int = SWEEPS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` and ``perplexity``.

    The model learns from rows where ``held_out`` is false and scores all."""
    with scratch(docs.sparkSession):
        rows = with_row_id(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out.alias("held_out")))
        return kept(_scored(rows, sweeps), "scores")


def _scored(rows: DataFrame, sweeps: int) -> DataFrame:
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = HOT * max(1, -(-size // 4 // BUCKET_TOKENS))  # a token has four bytes at least, on average; if less, there are more hot ones
    often = store(_frequent(rows, share), "frequent")
    tokens = sum(r.n for r in often.filter("kind = 0").collect())
    top = often.filter((F.col("kind") > 0) & (F.col("n") * share >= 0.75 * tokens)).collect()  # of each kind at most share / 0.75
    hot = [np.array([r.key for r in top if r.kind == kind], np.int64).view(np.uint64) for kind in (1, 2)]
    buckets = max(1, -(-tokens // BUCKET_TOKENS))
    merged = store_bucketed(_sent(rows, buckets, *hot).groupBy("bucket").applyInPandas(lambda part: _merged(part, buckets), _MERGED), "bucket", min(buckets, FILES))
    release(spark)
    orders = store_bucketed(_orders(merged), "part", min(buckets, FILES))

    known, sums, discounts, tables, before = spark.createDataFrame([], _KNOWN), [], (0.5, 0.5), [], []
    averaged = range(max(0, sweeps + 1 - AVERAGED), sweeps + 1)
    for sweep in range(sweeps + 1):
        one, known, stored = _sweep(merged, orders, known, sums, discounts, *hot)
        sums.append(one)
        tables.append(known)
        discounts = discounts if sweep else one.discounts()
        if before and sweep - 1 not in averaged:
            discard(*before[: 1 if sweep == 1 else 2])  # the customers' totals of the first sweep stay
        before = stored
        release(spark)
    discard(orders)
    d, d0 = discounts
    n_train, vocabulary = sums[0].tokens, sums[0].vocabulary
    customers = tables[0].filter("part >= 0").select("bucket", "part", F.lit(-1).alias("sweep"), "customers", F.lit(None).cast("binary").alias("tables"), *[F.lit(None).cast("binary").alias(c) for c in ("sizes", "root_tables", "root_sizes")])
    for sweep in averaged:
        customers = customers.unionByName(tables[sweep])

    def packed(rid: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
        blocks, at = np.unique(rid // DOCS, return_inverse=True)
        dense = np.zeros((len(blocks), DOCS, 4))
        dense[at, rid % DOCS] = held
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([x.tobytes() for x in dense], pa.binary())], names=["block", "sums"])

    def sums_by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid, held = np.zeros(0, np.int64), np.zeros((0, 4))  # the sums so far of the documents in this task's buckets
        for batch in batches:
            for i in range(batch.num_rows):
                one = lambda c, i=i, batch=batch: batch.column(batch.schema.get_field_index(c))[i].as_py()
                row = SimpleNamespace(bucket=one("bucket"), **{c: _unpacked(one(c), kind) for c, kind in _KINDS.items()})
                new, sums_of = document_sums(row, pd.DataFrame(one("known")))
                both = np.concatenate([rid, new])
                rid = np.unique(both)
                at = np.searchsorted(rid, both)
                both = np.concatenate([held, sums_of])
                held = np.stack([np.bincount(at, weights=both[:, j], minlength=len(rid)) for j in range(4)], axis=1)
                if len(rid) > HELD_ROWS:
                    yield packed(rid, held)
                    rid, held = rid[:0], held[:0]
        if len(rid):
            yield packed(rid, held)

    def total(part: pa.Table) -> pa.Table:
        sums = np.zeros((DOCS, 4))
        for x in part["sums"].to_pylist():
            sums += np.frombuffer(x).reshape(DOCS, 4)
        some = np.flatnonzero(sums[:, 0])
        return pa.table({"rid": part["block"][0].as_py() * DOCS + some} | {c: sums[some, i] for i, c in enumerate(("n", "known", "base", "score"))})

    def document_sums(row: SimpleNamespace, known: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        b = Bucket(row, *hot)
        count, p = b.own.copy(), np.zeros(len(b.k))
        count[b.hot_at] = [sums[0].hot_pairs[int(x)][0] for x in b.hot_keys]
        guests = b.by_context(known, -1, "customers", sums[0])[b.k]
        for sweep in averaged:
            s, last = b.seating(known, sweep), sums[sweep]
            tables = s.tables
            tables[b.hot_at] = [last.hot_pairs[int(key)][1] for key in b.hot_keys]
            root = last.root(*b.with_hot(s, last), d0)[b.word]
            p += (np.maximum(count - d * tables, 0) + (THETA + d * b.by_context(known, sweep, "tables", last)[b.k]) * root) / (THETA + guests)
        known_words = np.bincount(b.word, weights=b.own, minlength=len(b.words))
        for i in b.hot_words_at:
            known_words[i] = sums[0].hot_words[int(b.words[i])][0]
        base = np.log10((known_words + 0.5) / (n_train + 0.5 * (vocabulary + 1)))
        n = row.n.astype(np.float64)
        add = lambda x: np.bincount(row.doc, weights=np.repeat(x, row.runs) * n, minlength=len(row.rids))
        tokens = np.bincount(row.doc, weights=n, minlength=len(row.rids))
        return row.rids, np.stack([tokens, add((known_words > 0)[b.word].astype(float)), add(base[b.word]), add(np.log10(p / len(averaged)))], axis=1)

    listed = customers.groupBy("bucket").agg(F.collect_list(F.struct(*[c for c in customers.columns if c != "bucket"])).alias("known"))
    parts = merged.join(listed, "bucket").mapInArrow(sums_by_document, "block long, sums binary")
    by_doc = parts.groupBy("block").applyInArrow(total, "rid long, n double, known double, base double, score double")
    return rows.select("rid", "doc_id", "held_out").join(by_doc, "rid").select(
        "doc_id", "held_out", F.col("n").cast("long").alias("n_tokens"), F.col("known").cast("long").alias("n_known"), F.lit(int(n_train)).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n")).alias("perplexity"),
    )
