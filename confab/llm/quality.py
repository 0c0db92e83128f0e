"""A sparse rule ensemble for text quality.

Shallow trees of a random forest are grown on statistics of labelled texts; every path from a root is one conjunctive
rule. Over all rules, a logistic regression with lasso penalty is fitted, which leaves few of them a weight. The
model is a list of weighted rules, compiled into one Spark column expression over the statistics, so scoring runs in generated code.

The statistics are taken from the whole text in one pass; labels, languages, sources and ids are never among them.

Edge cases: null and empty texts have all statistics 0 and get a score like any other, very long ones are read whole. Rows without a label are scored but
not learned from; repeated rows and repeated labels count repeatedly, and equal texts get equal scores. Without labels of both kinds the score is the share of label 1 (0.5
without any). An empty table gives no rows. Other columns are kept, whatever their names; columns that bear the statistics' names (``s_...``) give way to these.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confab.llm.common import texts_of

#: Labelled rows that are fitted on, about, at most; beyond it a share of them is taken by a hash of their ids.
MAX_LABELLED = 200_000
TREES, DEPTH, LASSO = 24, 4, 0.0005

STATS = [
    "s_log_words", "s_upper", "s_symbols", "s_exclaims", "s_bare", "s_digits", "s_other_bytes", "s_word_length", "s_distinct_words",
    "s_repeats", "s_stops", "s_commas", "s_line_words", "s_distinct_lines", "s_repeated_marks", "s_longest_word", "s_spaces",
]

_NOT = {
    "upper": bytes(i for i in range(256) if not 65 <= i <= 90),
    "lower": bytes(i for i in range(256) if not (97 <= i <= 122 or i >= 128)),
    "symbols": bytes(i for i in range(256) if chr(i) not in "#$%&*+<=>@\\^_`{|}~[]"),
    "digits": bytes(i for i in range(256) if not 48 <= i <= 57),
    "spaces": bytes(i for i in range(256) if not (i == 32 or 9 <= i <= 13)),
    "other": bytes(range(128)),
}
#: All but punctuation and white space; words of punctuation alone.
_LETTERS = bytes(i for i in range(256) if i >= 128 or chr(i).isalnum() or i < 9 or 14 <= i < 32 or i == 127)
_BARE = re.compile(rb"(?<!\S)[!-/:-@\[-`{-~]+(?!\S)")


def statistics_of(text: bytes) -> tuple[float, ...]:
    """The statistics of one text, in the order of STATS."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return (0.0,) * len(STATS)
    count = {k: len(text.translate(None, v)) for k, v in _NOT.items()}
    letters = max(1, count["upper"] + count["lower"])
    lines = text.split(b"\n")
    lengths = list(map(len, words))
    return (
        math.log1p(n), count["upper"] / letters, count["symbols"] / size, text.count(b"!") / n, len(_BARE.findall(text)) / n, count["digits"] / size,
        count["other"] / size, sum(lengths) / n, len(set(words)) / n, sum(map(operator.eq, words, islice(words, 1, None))) / n, text.count(b".") / n,
        text.count(b",") / n, n / len(lines), len(set(lines)) / len(lines), sum(len(m) > 1 and m.count(m[:1]) == len(m) for m in text.translate(None, _LETTERS).split()) / n,
        math.log1p(max(lengths)), count["spaces"] / size,
    )


def with_statistics(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with the statistics in place of the text, or beside it."""
    keep = [f for f in docs.schema if f.name not in STATS and (keep_text or f.name != text)]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([statistics_of(x) for x in texts_of(batch, text)], dtype=np.float64).reshape(-1, len(STATS))
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(stats[:, i]) for i in range(len(STATS)))], names=[*names, *STATS])

    out = T.StructType([*keep, *(T.StructField(s, T.DoubleType()) for s in STATS)])
    return docs.select(*[f"`{n}`" for n in dict.fromkeys([*names, text])]).mapInArrow(run, out)


#: (statistic, whether it must be greater, threshold)
Condition = tuple[str, bool, float]


def _paths(model_text: str) -> set[tuple[Condition, ...]]:
    """All paths from the roots of the trees in a forest's description, each as sorted conditions without redundant ones."""
    found, path = set(), []
    for line in model_text.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if re.match(r" *Tree \d+", line):
            path = []
        elif m:
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, (STATS[int(m[2])], m[3] == ">", float(m[4])))]
            tight: dict[tuple[str, bool], float] = {}
            for _, (s, greater, x) in path:
                tight[s, greater] = (max if greater else min)(tight.get((s, greater), x), x)
            found.add(tuple(sorted((s, g, x) for (s, g), x in tight.items())))
    return found


def _holds(rule: tuple[Condition, ...]) -> Column:
    out = None
    for s, greater, x in rule:
        c = F.col(s) > x if greater else F.col(s) <= x
        out = c if out is None else out & c
    return out


@dataclass
class RuleModel:
    """Weighted conjunctive rules and an intercept."""

    intercept: float
    rules: list[tuple[float, tuple[Condition, ...]]]

    def score(self) -> Column:
        """The probability of label 1 as a column over the statistics."""
        z = F.lit(self.intercept)
        for w, rule in self.rules:
            z = z + F.when(_holds(rule), w).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def labelled_statistics(docs: DataFrame, labels: DataFrame, label: str = "label", text: str = "text", doc_id: str = "doc_id", max_rows: int = MAX_LABELLED) -> DataFrame:
    """Statistics and label of the documents in ``labels`` (doc_id, label): only their texts are looked at. Labels that are not 0 or 1 are left out; of more than
    ``max_rows`` labels a share is taken, so the side that is broadcast is bounded."""
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("__id"), F.col(label).cast("double").alias("label"))
    n = known.count()
    if n > max_rows:
        known = known.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))
    found = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(known), "__id")
    return with_statistics(found.select("label", "__text"), "__text")


def fit(known: DataFrame) -> RuleModel:
    """``known``: the statistics and ``label``, 0.0 or 1.0, of a bounded number of rows, as :func:`labelled_statistics` gives them."""
    n, ones = known.agg(F.count("*"), F.sum("label")).first()
    if not n or ones in (0, n):
        p = min(max((ones / n) if n else 0.5, 1e-6), 1 - 1e-6)
        return RuleModel(math.log(p / (1 - p)), [])
    known = known.persist()
    trees = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, subsamplingRate=0.5, featureSubsetStrategy="onethird", minInstancesPerNode=5, seed=7)
    forest = trees.fit(known.withColumn("features", array_to_vector(F.array(*STATS))))
    rules = sorted(_paths(forest.toDebugString))
    if not rules:
        known.unpersist()
        return RuleModel(math.log(ones / (n - ones)), [])
    matrix = known.select("label", array_to_vector(F.array(*[F.when(_holds(r), 1.0).otherwise(0.0) for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60).fit(matrix)
    known.unpersist()
    return RuleModel(float(lasso.intercept), [(float(w), r) for w, r in zip(lasso.coefficients, rules, strict=True) if w])
