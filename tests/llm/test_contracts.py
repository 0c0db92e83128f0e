"""The ten queries themselves, on small tables in files: columns, types and rows as the contracts say; and row numbers that outlast a change of parallelism."""

import hashlib
import importlib.util
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from confab.llm import common, exact_dedup, near_dedup, queries
from tests.llm.test_llm import ODD, SPACE, brute_components, brute_top, brute_url, near_copies, table

SMALL = "/root/testdata/sf0.001"
needs_vocabulary = pytest.mark.skipif(importlib.util.find_spec("public_tokenizers") is None, reason="no vocabulary files here")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """The smallest tables, with odd, repeated and near rows among the documents, in several files."""
    import random

    rng = random.Random(1)
    base = str(tmp_path_factory.mktemp("sf"))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    text = " ".join(f"w{rng.randrange(900)}" for _ in range(90))
    more = [*ODD, *near_copies(rng, text, 30, 4), *[docs[3][1]] * 9, docs[4][1].replace(" ", "\n")]
    rows = docs + [(max(i for i, _ in docs) + 1 + k, t) for k, t in enumerate(more)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{base}/documents.parquet")
    for name in ("labels", "pages", "embeddings"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{base}/{name}.parquet")
    return base, dict(rows)


def columns(df, *wanted):
    kinds = dict(df.dtypes)
    assert {c: kinds[c] for c, _ in wanted} == dict(wanted)
    return df.toPandas()


def test_op1(spark, sf):
    base, docs = sf
    out = columns(queries.op1_rule_ensemble_quality(spark, base), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")).set_index("doc_id")
    assert set(out.index) == set(docs) and out.score.between(0, 1).all()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for i, r in out.iterrows())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{base}/labels.parquet").collect()}
    held = [out.predicted[i] == q for i, q in labels.items() if out.held_out[i]]
    assert np.mean(held) >= 0.9
    texts = {}
    for i, t in docs.items():  # equal texts get equal scores
        assert texts.setdefault(t, out.score[i]) == out.score[i]


def test_op2(spark, sf):
    base, docs = sf
    out = columns(queries.op2_kd_sharding(spark, base), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int"))
    assert set(out.doc_id) == set(docs) and set(out.law) == {"bytes"} and out.grown_shard.isna().all() and set(out.shard) <= set(range(8))
    for r in out.itertuples():
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    fits = out.groupby("text_crc32")["size"].sum() <= out["size"].sum() / 8
    assert (out.groupby("text_crc32")["shard"].nunique()[fits] == 1).all()


def test_op3(spark, sf):
    base, docs = sf
    out = columns(queries.op3_pii_pseudonyms(spark, base), ("text", "string"), ("n_replaced", "int")).set_index("doc_id")
    assert set(out.index) == set(docs)
    assert all((r.text == docs[i]) == (r.n_replaced == 0) for i, r in out.iterrows() if docs[i] is not None)
    again = queries.op3_pii_pseudonyms(spark, base).toPandas().set_index("doc_id")
    assert (again.text.fillna("") == out.text.fillna("")).all()  # one key for a session


@needs_vocabulary
def test_op4_and_op5(spark, sf):
    from tokenizers import Tokenizer

    base, docs = sf
    library, sha = Tokenizer.from_file(queries.tokenizer_path()), lambda t: hashlib.sha256(t.encode()).hexdigest()
    library.no_truncation()
    library.no_padding()
    out = columns(queries.op4_bpe_backtracking(spark, base), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")).set_index("doc_id")
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in docs.items()}
    assert set(out.index) == set(docs)
    for i, x in ids.items():
        assert tuple(out.loc[i, ["n_tokens", "ids_sha256", "decoded_sha256"]]) == (len(x), sha(" ".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False)))
    pieces = columns(queries.op5_concat_packing(spark, base), *[(c, "bigint") for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    for i, g in pieces.sort_values("start").groupby("doc_id"):
        x, at = [*ids[i], 1], 0
        for r in g.itertuples():
            assert (r.start, r.doc_tokens) == (at, len(x)) and r.ids_crc32 == zlib.crc32(np.array(x[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(x)
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 2048
    assert set(pieces.doc_id) == set(docs)


def test_op6(spark, sf):
    base, _ = sf
    out = columns(queries.op6_url_filter(spark, base), ("host", "string"), ("path", "string"), ("rule", "string"), ("verdict", "string")).set_index("page_id")
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{base}/pages.parquet").collect()}
    assert set(out.index) == set(pages)
    for i, u in pages.items():
        r = out.loc[i]
        assert (r.host, r.path, r.rule) == brute_url(u, queries.URL_RULES)
        assert r.verdict == queries.URL_RULES[r.rule] if r.rule else r.verdict in ("allow", "block")


def test_op7(spark, sf):
    import math

    base, docs = sf
    out = columns(queries.op7_pitman_yor_scores(spark, base), ("held_out", "boolean"), *[(c, "bigint") for c in ("n_tokens", "n_known", "train_tokens")], ("base_score", "double"), ("score", "double")).set_index("doc_id")
    words = {i: [*(t or "").encode().lower().split(), None] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    count = {}
    for i, w in words.items():
        for x in w if not held[i] else ():
            count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, w in words.items():
        r = out.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(x in count for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
    assert out[out.held_out].score.sum() > out[out.held_out].base_score.sum()


def test_op8(spark, sf):
    base, _ = sf
    out = columns(queries.op8_dual_tree_top_k(spark, base), ("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint"))
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{base}/embeddings.parquet").collect()]
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in out.itertuples()} == brute_top(vectors, 5, 50)


def test_op9(spark, sf):
    base, docs = sf
    out = columns(queries.op9_chosen_path_near_dedup(spark, base), ("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")).set_index("doc_id")
    ids = sorted(docs)
    sizes, want = brute_components([docs[i] for i in ids])
    assert [out.n_shingles[i] for i in ids] == sizes and [out.component_id[i] for i in ids] == [ids[c] for c in want]
    assert all(out.kept[i] == (out.component_id[i] == i) for i in ids)


def test_op10(spark, sf):
    base, docs = sf
    out = columns(queries.op10_exact_dedup(spark, base), ("doc_id", "bigint"), ("keep_id", "bigint"), ("group_size", "bigint"), ("kept", "boolean"), ("text_sha256", "string")).set_index("doc_id")
    groups = {}
    for i, t in docs.items():
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i))
    for norm, own in groups.items():
        for _, i in own:
            assert tuple(out.loc[i, ["keep_id", "group_size", "kept", "text_sha256"]]) == (min(own)[1], len(own), i == min(own)[1], hashlib.sha256(norm.encode()).hexdigest())
    assert len(out) == len(docs)


def test_row_numbers_outlast_a_change_of_parallelism(spark, sf):
    base, _ = sf
    docs = spark.read.parquet(f"{base}/documents.parquet")
    one = common.with_row_id(docs).toPandas().set_index("rid").doc_id
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "23")
        two = common.with_row_id(spark.read.parquet(f"{base}/documents.parquet")).toPandas().set_index("rid").doc_id
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert one.index.is_unique and one.sort_index().equals(two.sort_index())
    made = common.with_row_id(docs.withColumn("x", F.rand()).repartition(3)).toPandas()
    assert made.rid.is_unique and len(made) == len(one)


def test_dropping_works_on_rows_that_are_not_in_files(spark):
    docs = table(spark, ["a b c d e f", "A b c d e f", "a b  c d e f", "x"])
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_copies(docs).collect()) == [1, 2, 3]
    assert sorted(r.doc_id for r in near_dedup.drop_near_copies(docs).collect()) == [0, 3]


def test_intermediate_tables_are_deleted(spark, sf):
    from pathlib import Path

    base, _ = sf
    folder = Path(common.shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    queries.op9_chosen_path_near_dedup(spark, base).count()
    queries.op7_pitman_yor_scores(spark, base).count()
    assert len(set(folder.iterdir()) - before) <= 2  # the two results


def test_results_do_not_depend_on_parallelism(spark, sf, monkeypatch):
    """Each stored step scans its files in other splits than the one before, as after lost or added executors."""
    from itertools import cycle

    from confab.llm import lm, topk

    base, _ = sf
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for module, query, key in (
        (near_dedup, queries.op9_chosen_path_near_dedup, ["doc_id"]), (exact_dedup, queries.op10_exact_dedup, ["doc_id"]),
        (topk, queries.op8_dual_tree_top_k, ["query_id", "rank"]), (lm, queries.op7_pitman_yor_scores, ["doc_id"]),
    ):
        run = lambda query=query, key=key: query(spark, base).toPandas().sort_values(key).reset_index(drop=True)
        want, sizes = run(), cycle(["20k", "1g", "300k"])

        def store(df, name, sizes=sizes):
            spark.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
            return common.store(df, name)

        with monkeypatch.context() as m:
            m.setattr(module, "store", store)
            got = run()
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        for c in want.columns:
            if want[c].dtype == float:
                assert np.allclose(want[c], got[c]), (query.__name__, c)
            else:
                assert want[c].equals(got[c]), (query.__name__, c)


@needs_vocabulary
def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, white, long and repeated texts, near copies, repeated rows, null ids, and columns that the operators use themselves; and an empty table."""
    import random

    import corpus_pipeline as cp
    from tests.llm.test_llm import DOC

    rng = random.Random(12)
    text = " ".join(f"w{rng.randrange(900)}" for _ in range(90))
    texts = [*ODD, *near_copies(rng, text, 12, 3), "card 4539 1488 0343 6467", "card 4539 1488 0343 6467"]
    rows = [(i, t, "en", "k", "r", "s", "n", "i") for i, t in enumerate(texts)] + [(3, texts[3], "en", "k", "r", "s", "n", "i"), (None, "no id here at all", "en", "k", "r", "s", "n", "i")]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")  # all is good
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in cp.STAGES[:-1]:
        out = common.store(stage(spark, docs, str(tmp_path)), name)
        assert out.columns == columns, name
        kept[name], docs = [(r.doc_id, r.text) for r in out.collect()], out
    assert sorted(kept["quality"], key=str) == sorted(((r[0], r[1]) for r in rows), key=str)
    best = {}
    for i, t in kept["quality"]:
        k = SPACE.sub("", t or "")
        best[k] = min(best.get(k, (1, False, 0)), (-len(t or ""), i is None, -1 if i is None else i))
    assert sorted(kept["exact_dedup"], key=str) == sorted(((None if none else i, next(t for j, t in kept["quality"] if j == (None if none else i))) for _, none, i in best.values()), key=str)
    near = sorted((i, t) for i, t in kept["exact_dedup"] if i is not None)
    _, want = brute_components([t for _, t in near])
    assert sorted(kept["near_dedup"], key=str) == sorted([near[c] for c in set(want)] + [r for r in kept["exact_dedup"] if r[0] is None], key=str)
    private = dict(kept["pii"])
    assert all(private[i] == t for i, t in kept["near_dedup"] if "card" not in (t or "")) and not any("4539 1488" in (t or "") for t in private.values())
    pieces = cp.packing_stage(spark, docs, str(tmp_path)).toPandas()
    assert pieces.doc_id.nunique(dropna=False) == len(private) and (pieces.groupby("sequence_id")["length"].sum() <= 2048).all()
    empty = spark.createDataFrame([], DOC)
    for _, stage in cp.STAGES:
        empty = common.store(stage(spark, empty, str(tmp_path)), "empty")
        assert empty.count() == 0
