"""The main text of web pages: the best contiguous region, words scoring positive and tags negative.

A page is cut into tags and runs of words. A word scores its log odds of being main text, from what it stands in: the names of the elements around it and the words of their
classes, ids, roles and item properties. In the text of an article these are positive. A tag scores a negative amount, by its name: its log odds, where these are
negative, and a small amount otherwise. All weights are learned from labelled pages (:func:`fit`). One linear scan finds the contiguous part of the page with the highest sum (Kadane's rule, as in
"maximum subsequence segmentation", Pasternack and Roth 2009); a run of words with one score is one item of the scan. Blocks that the region touches are whole, and those
within it whose words score negative in all, such as an advert between two paragraphs, are left out.

Scripts, styles, comments, form fields and what is hidden are never text. Elements are closed as HTML says for paragraphs, list items and table parts that lack their end tags. A form that holds more than half of the page's words is a page in
a form, and counts as no form.

Text: character references are decoded in each piece of text, white space (Unicode's) within a block becomes one space, blocks are trimmed and joined by one space in page order. Tags of phrases
(``b``, ``a``) do not separate words; ``br`` and blocks do.

Edge cases: null or empty html, or a page without main text, gives an empty text. Very long pages are read whole, in time that grows with their length. Tags that are not closed before the page ends are
left out; a lone ``<`` is text. Repeated pages get equal texts, and of regions of equal scores the first is taken, at its shortest. An empty table gives no rows. All other columns stay; those that are named as the results are replaced.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.llm.common import by_size

# Kinds of HTML elements.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PHRASE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("head noscript template svg math object canvas audio video map select option optgroup datalist button input progress meter dialog".split()) | RAW
#: What an opening tag closes, and the element beyond which it does not look.
CLOSES = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th", "caption"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr"))}
CLOSES |= dict.fromkeys(("tbody", "thead", "tfoot"), (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)))
BOUNDARY = frozenset("html body table ul ol dl td th caption div section article main aside nav header footer form blockquote figure fieldset details".split())
OF_HEAD = frozenset("head title meta link script style base noscript template".split())
ATTRIBUTES = frozenset("class id role itemprop".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>"'=]++|=\s*(?:"[^"]*"|'[^']*')?|["'])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _hints(name: str, rest: str) -> tuple[tuple[str, ...], bool]:
    """What an element tells of its text: its name, and ``.word`` for each word of the attributes that name things; and whether it is hidden."""
    found, hidden = {name: None}, name.removeprefix("inner ") in UNSEEN
    for key, value in _ATTRIBUTE.findall(rest) if rest.strip() else ():
        key, value = key.lower(), value.strip("\"'")
        if key in ATTRIBUTES:
            found.update(dict.fromkeys("." + w for w in _WORD.findall(_HUMP.sub(" ", value).lower())))
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            hidden = True
    return tuple(found), hidden


class Page:
    """A page as ``items``, in page order: ``(tag's name, None)`` or ``(text, number of its place)``; ``places``: the hints of all elements around a text, each place once.

    With ``known``, other hints are left out, so a place is never larger than that, however deep it lies."""

    def __init__(self, source: str, known: dict | None = None):
        self.items: list[tuple[str, int | None]] = []
        self.places: list[tuple[str, ...]] = []
        self.main: list[bool] = []  # for each item, whether it lies between the marks of labelled pages
        self._known = known
        self._stack: list[tuple[str, tuple[str, ...], bool]] = []
        self._open: dict[str, list[int]] = defaultdict(list)  # places in the stack, by name
        self._bounds: list[int] = []
        self._unseen, self._number, self._marked, self._last = 0, {}, False, None
        at = 0
        while (m := _TOKEN.search(source, at)) is not None:
            self._text(source[at : m.start()])
            at = m.end()
            if m["name"] is None:
                self._marked = {MAIN: True, END_MAIN: False}.get(m[0], self._marked)
                continue
            name = m["name"].lower()
            if m["end"]:
                self._end(name)
                continue
            self._begin(name, m["rest"])
            if name in RAW:
                end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(source, at)
                at = end.start() if end else len(source)
        self._text(source[at:])

    def _item(self, name: str, place: int | None = None) -> None:
        self.items.append((name, place))
        self.main.append(self._marked)

    def _text(self, raw: str) -> None:
        if raw and not self._unseen:
            place = self._stack[-1][1] if self._stack else ()
            if self._last is not place:  # most texts lie where the one before lay
                self._last, self._at = place, self._number.setdefault(place, len(self.places))
                if self._at == len(self.places):
                    self.places.append(place)
            self._item(html.unescape(raw), self._at)

    def _begin(self, name: str, rest: str) -> None:
        if self._open["head"] and name not in OF_HEAD:
            self._pop(self._open["head"][0])
        if name in CLOSES:
            closed, within = CLOSES[name]
            least = max((self._open[w][-1] for w in within if self._open[w]), default=-1)
            inner = [self._open[c][i] for c in closed if (i := bisect_right(self._open[c], least)) < len(self._open[c])]
            if inner:
                self._pop(min(inner))
        elif name not in PHRASE and name != "br" and self._open["p"] and self._open["p"][-1] > (self._bounds[-1] if self._bounds else -1):
            self._pop(self._open["p"][-1])
        self._item(name)
        if name in VOID:
            return
        hints, hidden = _hints("inner " + name if name == "header" and (self._open["article"] or self._open["main"]) else name, rest)
        around = self._stack[-1][1] if self._stack else ()
        if new := [h for h in hints if h not in around and (self._known is None or h in self._known)]:
            around = (*around, *new)
        self._open[name].append(len(self._stack))
        if name in BOUNDARY:
            self._bounds.append(len(self._stack))
        self._stack.append((name, around, hidden))
        self._unseen += hidden

    def _end(self, name: str) -> None:
        if self._open[name]:
            to = self._open[name][-1]
            if (name in PHRASE or name == "p") and self._bounds and self._bounds[-1] > to:
                return  # misnested: a phrase does not close the blocks in it
            self._pop(to)
        self._item("/" + name)

    def _pop(self, to: int) -> None:
        while len(self._stack) > to:
            name, _, hidden = self._stack.pop()
            self._open[name].pop()
            self._unseen -= hidden
            if self._bounds and self._bounds[-1] == len(self._stack):
                self._bounds.pop()

    def all_in_form(self) -> bool:
        n = Counter()
        for text, place in self.items:
            if place is not None and not text.isspace():
                n["form" in self.places[place]] += len(text.split())
        return n[True] > n[False]

    def blocks(self) -> list[list[int]]:
        """The texts of each block, as numbers of items."""
        out, now = [], []
        for i, (name, place) in enumerate(self.items):
            if place is not None:
                now.append(i)
            elif name.removeprefix("/") not in PHRASE and now:
                out.append(now)
                now = []
        return [*out, now] if now else out


# --- weights --------------------------------------------------------------------------------------------------------

#: Labelled pages have their main text between these.
MAIN, END_MAIN = "<!--main-->", "<!--/main-->"
#: What a tag costs at least, and at most.
LEAST_COST, MOST_COST = 0.02, 2.0


class Weights:
    """``bias`` and ``hints``: a word's log odds; ``tags``: what each tag scores, a negative number."""

    def __init__(self, bias: float, hints: dict[str, float], tags: dict[str, float]):
        self.bias, self.hints, self.tags = bias, hints, tags

    def of_place(self, place: tuple[str, ...], without: frozenset[str] = frozenset()) -> float:
        return self.bias + sum(self.hints.get(h, 0.0) for h in place if h not in without)

    def of_tag(self, name: str) -> float:
        return self.tags.get(name.removeprefix("/"), -LEAST_COST)


def examples(pages: DataFrame, source: str = "html") -> DataFrame:
    """From labelled pages, one row for each piece of text (``hints``, ``label`` 1.0 for main text) and each tag (``tag``, ``label``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in by_size(whole, source):
                rows = []
                for raw in texts:
                    page = Page(raw.decode())
                    rows += [(sorted(page.places[place]), None, float(main)) for (text, place), main in zip(page.items, page.main, strict=True) if place is not None and not text.isspace()]
                    rows += [(None, name.removeprefix("/"), float(main)) for (name, place), main in zip(page.items, page.main, strict=True) if place is None]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], names=["hints", "tag", "label"])

    return pages.select(source).mapInArrow(run, "hints array<string>, tag string, label double")


def fit(pages: DataFrame, source: str = "html", reg: float = 0.000001, most_hints: int = 4096) -> Weights:
    """The weights from labelled pages, whose main text stands between MAIN and END_MAIN. The weights of the most frequent ``most_hints`` hints are kept."""
    known = examples(pages, source).cache()
    places = known.filter("hints is not null").groupBy("hints", "label").agg(F.sqrt(F.count("*").cast("double")).alias("n")).coalesce(2).cache()
    vectors = CountVectorizer(inputCol="hints", outputCol="features", vocabSize=most_hints, binary=True).fit(places)
    model = LogisticRegression(regParam=reg, weightCol="n", standardization=False, maxIter=100).fit(vectors.transform(places))
    hints = dict(zip(vectors.vocabulary, map(float, model.coefficients.toArray()), strict=True))
    bias = float(model.intercept)
    counts = known.filter("tag is not null").groupBy("tag").agg(F.sum("label").alias("in"), F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(most_hints).collect()
    known.unpersist()
    places.unpersist()
    odds = {r.tag: math.log((r["in"] + 1) / (r.n - r["in"] + 1)) for r in counts}
    return Weights(bias, hints, {tag: -min(MOST_COST, max(LEAST_COST, -x)) for tag, x in odds.items()})


# --- extraction -----------------------------------------------------------------------------------------------------


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous part with the highest sum, as (first, behind the last); the first such, at its shortest; empty if no sum is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(source: str, weights: Weights) -> str:
    page = Page(source, weights.hints)
    without = frozenset(["form"]) if page.all_in_form() else frozenset()
    word = [weights.of_place(p, without) for p in page.places]
    counts = [0 if place is None else len(text.split()) for text, place in page.items]
    scores = [weights.of_tag(text) if place is None else word[place] * n for (text, place), n in zip(page.items, counts, strict=True)]
    first, last = best_region(scores)
    out = []
    for block in page.blocks():
        if block[-1] >= first and block[0] < last and sum(scores[i] for i in block) > 0:
            out.append(" ".join("".join(page.items[i][0] for i in block).split()))
    return " ".join(x for x in out if x)


def extract(pages: DataFrame, weights: Weights, source: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``pages`` without ``source``, with the main text of each and its length in code points."""
    rest = [c for c in pages.columns if c not in (source, text, n_chars)]
    rows = pages.select(*rest, F.col(source).cast("string").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in by_size(whole, "__html"):
                found = [main_text(x.decode(), weights) for x in texts]
                columns = [batch.column(i) for i in range(len(rest))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=[*rest, text, n_chars])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*kinds, f"`{text}` string", f"`{n_chars}` long"]))
