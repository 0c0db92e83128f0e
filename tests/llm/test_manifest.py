"""The manifest against a tree built in plain Python: sizes around powers of eight, nulls, repeated rows, proofs of changed rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from confab.llm import manifest, queries

COLUMNS = queries.MANIFEST_COLUMNS


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lift(nodes, steps):
    """``nodes``: (hash, the leaves under it); adds to each leaf's steps its siblings at this level."""
    out = []
    for at in range(0, len(nodes), 8):
        run = nodes[at : at + 8]
        for k, (_, under) in enumerate(run):
            for x in under:
                steps[x].append(("".join(n for n, _ in run[:k]), "".join(n for n, _ in run[k + 1 :])))
        out.append((h(*[n for n, _ in run]), [x for _, under in run for x in under]))
    return out


def brute(docs):
    leaf = [h(*map(field, d)) for d in docs]
    changed = [d[:4] + (d[4].translate({c: c + 32 for c in range(65, 91)}),) if d[4] is not None and d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0 else d for d in docs]
    steps, tops = {i: [] for i in range(len(docs))}, []
    for lang in sorted({d[2] for d in docs}, key=lambda x: (x is not None, (x or "").encode())):
        order = sorted((i for i, d in enumerate(docs) if d[2] == lang), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, leaf[i]))
        nodes = [(leaf[i], [i]) for i in order]
        while len(nodes) > 1:
            nodes = lift(nodes, steps)
        tops += nodes
    subroot = {i: top for top, under in tops for i in under}
    while len(tops) > 1:
        tops = lift(tops, steps)
    out = []
    for i, d in enumerate(docs):
        now = h(*map(field, changed[i]))
        for a, b in steps[i]:
            now = h(a, now, b)
        out.append((d[0], leaf[i], subroot[i], tops[0][0], h("".join(a + b for a, b in steps[i])), now, now == tops[0][0]))
    return sorted(out, key=str)


def built(spark, tmp_path, docs):
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars int, text string").withColumns({"leaf": F.lit(1), "root": F.lit("x"), "steps": F.lit(2)})
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_merkle_manifest(spark, str(tmp_path))
    assert dict(out.dtypes) == {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"}
    return sorted(map(tuple, out.collect()), key=str)


ODD = [(None, None, None, None, None), (None, "s", None, 3, "AbC"), (-5, "s", "", 0, ""), (0, "", "Zz", 1, "ÄB"), (12, "s", "é", 9, "long " * 20_000), (12, "s", "é", 9, "long " * 20_000)]


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65, 517])
def test_sizes(spark, tmp_path, n):
    docs = [(i * 3 - 7, f"src{i % 2}", "en" if i % 3 else "de", i, f"Text number {i}") for i in range(n)]
    assert built(spark, tmp_path, docs) == brute(docs)


def test_odd_rows_and_many_groups(spark, tmp_path):
    docs = ODD + [(1000 + i, "s", f"l{i % 11}", 4, "Same") for i in range(130)] + [(77, "s", "en", 4, "Copy")] * 20
    assert built(spark, tmp_path, docs) == brute(docs)


def test_any_fan(spark):
    docs = spark.createDataFrame([(i, "a", f"t{i}") for i in range(11)], "id int, g string, t string")
    out = manifest.manifest(docs, ["id", "t"], "g", "id", {"t": F.when(F.col("id") == 4, F.lit("other")).otherwise(F.col("t"))}, fan=2).collect()
    assert len({r.root for r in out}) == 1 and {r.id for r in out if not r.verified} == {4}
