"""The queries of the operators over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import secrets
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.llm import bpe, exact_dedup, hard_negatives, html_text, labelled_pages, lm, manifest, near_dedup, packing, pii, quality, sharding, topk, url_filter
from confab.llm.common import held_out, kept, scratch, store


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def tokenizer_path() -> str:
    """The vocabulary file of the contracts for op4 and op5."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A document is predicted good from this score on.
QUALITY_CUT = 0.3


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.RuleModel:
    """The rules learned from the labelled rows of ``docs`` (doc_id, text) that are not held out."""
    labels = _table(spark, sf_dir, "labels", "doc_id", "quality").filter(~held_out("doc_id", 0))
    with scratch(spark):
        return quality.fit(store(quality.labelled_statistics(docs, labels, "quality"), "labelled"))


def op1_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    score = quality_model(spark, docs, sf_dir).score()
    scored = quality.with_statistics(docs).select("doc_id", held_out("doc_id", 0).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= QUALITY_CUT, 1).otherwise(0))


SHARDS = 8


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes; equal texts stay in one shard unless they are too many bytes for one."""
    with scratch(spark):
        sizes = store(sharding.document_sizes(_table(spark, sf_dir, "documents", "doc_id", "text")), "sizes")
        shards = sharding.balanced_shards(sizes, ["n_chars", "text_crc32"], SHARDS)
        out = kept(sharding.with_slots(shards, "shard", F.struct("doc_id", "text_crc32")), "shards")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The secret key of the pseudonyms. Where it is not set, each session draws its own.
PII_KEY = "spark.confab.pii.key"


def pii_key(spark: SparkSession) -> str:
    if not spark.conf.get(PII_KEY, None):
        spark.conf.set(PII_KEY, secrets.token_hex(16))
    return spark.conf.get(PII_KEY)


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return pii.pseudonymise(docs, pii_key(spark), found="n_replaced")


def op4_bpe_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bpe.encode(_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(), decoded="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return docs.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op5_concat_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


#: The contract's rules.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages", "page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "block_probability")


def op7_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents", "doc_id", "text"), held_out("doc_id", 1))


def op8_dual_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op9_chosen_path_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf_dir, "documents", "doc_id", "text")).drop("rid")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents", "doc_id", "text")).drop("rid")


def page_weights(spark: SparkSession) -> html_text.Weights:
    """Weights learned from the labelled pages of this package."""
    labelled = spark.createDataFrame([(p,) for p in labelled_pages.pages()], "html string").repartition(4)
    return html_text.fit(labelled)


def op11_best_region_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages", "page_id", "url", "html"), page_weights(spark))


def op12_slot_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    sevenths = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), F.col("vec_id") % 50 == 0, sevenths)


#: What a leaf of the manifest is made of.
MANIFEST_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tampered rows, those whose id's checksum 3 divides, have A-Z of their texts in lower case."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    docs = _table(spark, sf_dir, "documents", *MANIFEST_COLUMNS)
    return manifest.manifest(docs, MANIFEST_COLUMNS, "lang", "doc_id", {"text": F.when(hit, lower).otherwise(F.col("text"))})


QUERIES = {
    "op1_rule_ensemble_quality": op1_rule_ensemble_quality,
    "op2_kd_sharding": op2_kd_sharding,
    "op3_pii_pseudonyms": op3_pii_pseudonyms,
    "op4_bpe_backtracking": op4_bpe_backtracking,
    "op5_concat_packing": op5_concat_packing,
    "op6_url_filter": op6_url_filter,
    "op7_pitman_yor_scores": op7_pitman_yor_scores,
    "op8_dual_tree_top_k": op8_dual_tree_top_k,
    "op9_chosen_path_near_dedup": op9_chosen_path_near_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_best_region_text": op11_best_region_text,
    "op12_slot_hard_negatives": op12_slot_hard_negatives,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: Levels of the manifest that its SQL has: enough for 8 ** 6 rows of a language.
SQL_LEVELS = 6


def _manifest_sql() -> str:
    """Level by level: ``t`` has the nodes, ``f`` each leaf's siblings at that level."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in [*MANIFEST_COLUMNS[:-1], text]) + ")"
    # a byte is mixed in, then the eight bits are shifted out
    steps = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_concat([4294967295], {steps}), lambda h, s: CASE WHEN s >= 0 THEN xor(h, s) ELSE xor(h >> 1, 3988292384 * (h & 1)) END), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""c AS MATERIALIZED (
          SELECT doc_id, lang, {leaf("text")} AS h, {leaf("changed")} AS now
          FROM (SELECT *, CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {lower} ELSE text END AS changed FROM documents)),
        l AS MATERIALIZED (
          SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM c),
        t0 AS (SELECT lang AS g, i, n, h FROM l),
        f0 AS (SELECT lang AS g, i, n, doc_id, h AS leaf, now AS h, '' AS proof FROM l)"""
    ]

    def levels(t: str, f: str, count: int, extra: str) -> None:
        for k in range(count):
            up = "CASE WHEN n > 1 THEN (n + 7) // 8 ELSE 1 END AS n"
            fold = "CASE WHEN n > 1 THEN sha256(a || h || b) ELSE h END AS h, CASE WHEN n > 1 THEN proof || a || b ELSE proof END AS proof"
            parts.append(f"r{t}{k} AS MATERIALIZED (SELECT g, i // 8 AS j, n AS m, list(h ORDER BY i) AS hs FROM {t}{k} GROUP BY g, i // 8, n)")
            parts.append(f"{t}{k + 1} AS MATERIALIZED (SELECT g, j AS i, h, {up} FROM (SELECT g, j, m AS n, CASE WHEN m > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM r{t}{k}))")
            sides = "array_to_string(list_slice(hs, 1, i % 8), '') AS a, array_to_string(list_slice(hs, i % 8 + 2, 8), '') AS b"
            parts.append(f"{f}{k + 1} AS MATERIALIZED (SELECT g, i // 8 AS i, {extra}, {up}, {fold} FROM (SELECT f.*, {sides} FROM {f}{k} f JOIN r{t}{k} r ON r.g IS NOT DISTINCT FROM f.g AND r.j = f.i // 8))")

    levels("t", "f", SQL_LEVELS, "doc_id, leaf")
    parts.append(f"s AS MATERIALIZED (SELECT g AS lang, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t{SQL_LEVELS})")
    parts.append("u0 AS (SELECT 0 AS g, i, n, subroot AS h FROM s)")
    parts.append(f"v0 AS (SELECT 0 AS g, s.i, s.n, f.doc_id, f.leaf, s.subroot, f.h, f.proof FROM f{SQL_LEVELS} f JOIN s ON s.lang IS NOT DISTINCT FROM f.g)")
    levels("u", "v", 2, "doc_id, leaf, subroot")
    last = "SELECT doc_id, leaf, subroot, u2.h AS root, sha256(proof) AS proof_sha256, v2.h AS folded_root, v2.h = u2.h AS verified FROM v2 JOIN u2 USING (g)"
    return "WITH " + ", ".join(parts) + " " + last


ORACLE_SQL = {
    "op8_dual_tree_top_k": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
          WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op9_chosen_path_near_dedup": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (
          SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] ELSE
                 list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) END)) AS g FROM w),
        n AS (SELECT w.doc_id, count(g) AS k FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= 75 * (u.k + v.k - c)),
        r AS (SELECT doc_id AS v, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v)
        SELECT n.doc_id, n.k AS n_shingles, min(r.c) AS component_id, n.doc_id = min(r.c) AS kept
        FROM n JOIN r ON r.v = n.doc_id GROUP BY n.doc_id, n.k
    """,
    "op10_exact_dedup": r"""
        WITH n AS (
          SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                 regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
          FROM documents),
        r AS (
          SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
                 first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id
          FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
    """,
    "op12_slot_hard_negatives": """
        WITH v AS (
          SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x,
                 CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
          FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT a.row AS anchor, a.vec_id AS anchor_id, c.row AS row, c.vec_id AS vec_id, a.label = c.label AS same,
                 list_inner_product(a.x, c.x)::BIGINT AS score
          FROM v a JOIN v c ON a.row <> c.row WHERE a.vec_id % 50 = 0),
        p AS (
          SELECT anchor, row AS positive, vec_id AS positive_id, score AS positive_score,
                 row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
        n AS (
          SELECT s.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
                 row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.vec_id) AS rank
          FROM p JOIN s USING (anchor)
          WHERE p.place <= 5 AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
        SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
    """,
    "op13_merkle_manifest": _manifest_sql(),
}
