"""Hard negatives against brute force: ties, copies, hot labels, odd rows, several chunks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from confab.llm import hard_negatives


def brute(rows, positives=5, negatives=3, low=50, high=95):
    """``rows``: (vec_id, label, vector), in full."""
    fine = [(v, l, [math.floor(256 * c) for c in x]) for v, l, x in rows if v is not None and l is not None and x and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for i, (a, label, x) in enumerate(fine):
        if a % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), v, l) for j, (v, l, y) in enumerate(fine) if j != i)
        for s, p, l in [t for t in scored if t[2] == label][:positives]:
            hits = [(-n, v) for n, v, m in scored if m != label and low * -s <= 100 * -n <= high * -s][:negatives]
            out += [(a, p, k, v, -s, n) for k, (n, v) in enumerate(hits, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<float>, rank int, score string")
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 50 == 0, **more).collect())


def clouds(rng, n, labels, dim=6):
    centres = [[rng.uniform(0.2, 1) for _ in range(dim)] for _ in range(labels)]
    rows = []
    for i in range(n):
        label = 0 if rng.random() < 0.4 else rng.randrange(labels)
        rows.append((i, label, [round(c + rng.gauss(0, 0.3), 3) for c in centres[label]]))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force_over_several_chunks(spark, monkeypatch, seed):
    monkeypatch.setattr(hard_negatives, "CHUNK", 8 * 6 * 40)
    monkeypatch.setattr(hard_negatives, "ROWS_TOGETHER", 3)
    monkeypatch.setattr(hard_negatives, "ANCHORS_TOGETHER", 1)
    rng = random.Random(seed)
    rows = clouds(rng, 700, 4)
    rows += [(1000 + 25 * i, 1, rows[3][2]) for i in range(60)] + [(3000 + i, 2, rows[3][2]) for i in range(60)]  # hot vectors, anchors among them
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, positives=2, negatives=7, low=10, high=100) == brute(rows, 2, 7, 10, 100)


def test_odd_rows(spark):
    good = [0.5, 0.25]
    rows = [
        (0, 1, good), (0, 1, good), (1, 1, [0.5, 0.3]), (2, 2, [0.4, 0.2]), (2, 2, [0.4, 0.2]), (3, None, good), (4, 2, None), (5, 2, [None, 1.0]), (6, 2, [float("nan"), 1.0]), (7, 2, [float("inf"), 1.0]),
        (None, 2, good), (8, 2, []), (50, 3, good), (100, 1, [-0.5, -0.25]), (150, -4, [0.0, 0.0]),
    ]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0])]) == []


def test_scores_beyond_64_bits_do_not_break(spark):
    rows = [(0, 1, [3e38, 1.0]), (1, 1, [3e38, 1.0]), (2, 2, [-3e38, 1.0]), (3, 2, [1.0, 1.0])]
    assert all(r[4] == (1 << 63) - 1 for r in mined(spark, rows))
