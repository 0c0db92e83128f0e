"""URL filtering by domain rules and, where none fits, by logistic regression on hashed character n-grams.

Host and path are taken from the url by the contract's definitions. Rules are compiled into one column expression,
longest first. The model is trained by Spark's LogisticRegression on a small labelled table of urls: n-grams
of host and of path, marked by their kind, are hashed into a fixed number of buckets. All of it runs in the JVM.

Edge cases: a null url, or one without ``://``, has an empty host and path: no rule fits and the model judges the empty url; very long ones are judged whole.
Repeated urls get the same verdict; a probability that equals the threshold blocks; of rules of one length the later one in the order of the alphabet wins. Without labelled rows every undecided url is allowed; with labels of one kind, it gets that
kind. Columns ``host``, ``path``, ``rule``, ``block_probability`` and ``verdict`` are replaced by the results; all others stay, whatever their names but for those that begin with two underscores. An empty table gives no rows.

The model is fitted on at most about MAX_LABELLED distinct labelled urls, half of them of each label where there are enough.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confab.llm.common import delete, shared_dir

#: Buckets of hashed n-grams, and the lengths of n-grams.
BUCKETS, LENGTHS = 1 << 14, (3, 4)
#: At most about so many distinct labelled urls are fitted on.
MAX_LABELLED = 5_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case; empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The longest rule, ``host/path``, whose host is the url's or a parent domain of it and whose path starts the url's; else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in rules.items():
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def _grams(text: Column, mark: str) -> Column:
    padded = F.concat(F.lit("^"), text, F.lit("$"))
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(padded) - n + 1, F.lit(1))), lambda i: F.concat(F.lit(mark), F.substring(padded, i, F.lit(n))))
    return F.concat(*[of(n) for n in LENGTHS])


def with_features(urls: DataFrame) -> DataFrame:
    """Adds ``__features`` from the columns ``host`` and ``path``."""
    grams = urls.withColumn("__grams", F.concat(_grams(F.col("host"), "h"), _grams(F.col("path"), "p")))
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol="__grams", outputCol="__features").transform(grams).drop("__grams")


def train(labelled: DataFrame, max_rows: int = MAX_LABELLED, reg: float = 0.01) -> LogisticRegressionModel | float:
    """``labelled``: host, path, label (1.0 block, 0.0 allow). The model, or the one label there is (0.0 for none)."""
    rows = labelled.groupBy("host", "path").agg(F.max("label").alias("label"))
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return next(iter(counts), 0.0)
    least = min(counts.values())
    share = {x: min(1.0, max(max_rows / 2, max_rows - least) / n) for x, n in counts.items()}
    drawn = F.pmod(F.xxhash64("host", "path"), F.lit(1 << 30))
    sample = with_features(rows.filter(F.when(F.col("label") == 1, drawn < int(share[1.0] * (1 << 30))).otherwise(drawn < int(share[0.0] * (1 << 30))))).select("label", "__features")
    fitted = LogisticRegression(maxIter=30, regParam=reg, featuresCol="__features", rawPredictionCol="__raw", probabilityCol="__probability", predictionCol="__prediction").fit(sample)
    # the fitted model carries its training's session along, which tasks can't receive; one that was stored is coefficients alone
    path = f"{shared_dir(labelled.sparkSession)}/confab-{uuid.uuid4().hex}/model"
    fitted.write().save(path)
    try:
        return LogisticRegressionModel.load(path)
    finally:
        delete(labelled.sparkSession, [path])


def judge(urls: DataFrame, rules: dict[str, str], model: LogisticRegressionModel | float | None = None, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """``urls`` with host, path, rule, block_probability and verdict. Without a model, one is trained on the urls that rules decide."""
    url_of = F.col(url)
    parts = urls.withColumns({"__host": host_of(url_of), "__path": path_of(url_of)}).withColumns({"host": F.col("__host"), "path": F.col("__path")}).drop("__host", "__path")
    parts = parts.withColumn("rule", matched_rule(F.col("host"), F.col("path"), list(rules)))
    if model is None:
        known = parts.filter("rule is not null").select("host", "path", F.when(verdict_of(F.col("rule"), rules) == "block", 1.0).otherwise(0.0).alias("label"))
        model = train(known)
    if isinstance(model, float):
        scored = parts.withColumn("block_probability", F.lit(model))
    else:
        scored = model.transform(with_features(parts)).withColumn("block_probability", vector_to_array("__probability")[1]).drop("__features", "__raw", "__probability", "__prediction")
    guess = F.when(F.col("block_probability") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.withColumn("verdict", F.coalesce(verdict_of(F.col("rule"), rules), guess))
