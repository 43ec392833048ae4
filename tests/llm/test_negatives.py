"""Hard negatives against scores of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from adloom.llm.negatives import Block, bounds, hard_negatives, moved_label, summarised, summaries, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, q string, print string, score double, _group int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, k, 9, "q", "p", 0.5, 1) for i, v, k in rows], SCHEMA)


def brute(rows, every=100, positives=5, negatives=10):
    """Rows with plain loops; rows of one id must be the same."""
    seen = {}
    for i, v, k in rows:
        if i is None or k is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        seen[i] = ([math.floor(256 * float(np.float32(x))) for x in v], (k + 1) % 10 if i % 7 == 0 else k)
    out = []
    for a, (q, label) in seen.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(q, v)) for i, (v, _) in seen.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if seen[i][1] == label][:positives]:
            fit = [i for i in order if seen[i][1] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fit[:negatives])]
    return sorted(out)


def mined(spark, rows, **options):
    return sorted(tuple(r) for r in hard_negatives(table(spark, rows), label=moved_label(), **options).collect())


@pytest.fixture(scope="module")
def plain():
    """Clusters, copies of one vector under a common label, ties, and rows that take no part."""
    rng = random.Random(2)
    centres = [[rng.gauss(0, 0.2) for _ in range(24)] for _ in range(12)]
    rows = []
    for k in range(900):
        c = centres[0] if k % 3 == 0 else rng.choice(centres)
        v = list(c) if k % 9 == 0 else [x + rng.gauss(0, 0.1) for x in c]
        rows.append((k, v, 1 if k % 3 == 0 else rng.randrange(10)))
    odd = [(1000, None, 3), (1100, [0.1, None], 3), (1200, [math.nan] * 24, 3), (1300, [math.inf, 1.0], 3),
           (1400, [0.1] * 24, None), (None, [0.1] * 24, 3), (1500, [], 3), (1600, [1.0, 2.0], 4), (-100, [0.0] * 24, 5),
           (-200, [-x for x in centres[1]], 1), (1700, centres[2], 77)]
    return rows + odd


def test_equals_all_pairs(spark, plain):
    got = mined(spark, plain)
    assert got == brute(plain) and len(got) > 100


def test_repeated_rows_are_one_and_order_does_not_matter(spark, plain):
    again = plain + plain[:300]
    random.Random(4).shuffle(again)
    assert mined(spark, again, every=50, positives=2, negatives=3) == brute(plain, 50, 2, 3)


def test_rows_that_share_an_id_stay_apart(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [0.0, 1.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.5], 2)]
    assert mined(spark, rows, positives=1) == [(100, 1, 1, 2, 65536, 32768)]


def test_nothing_and_alone(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1)]) == [] and mined(spark, [(100, [], 1), (1, [], 1), (2, [], 2)]) == [(100, 1, 1, 2, 0, 0)]


def test_large_components_are_exact(spark):
    rows = [(100, [3.0e5, 1.0], 1), (1, [3.0e5, 0.5], 1), (2, [2.0e5, -7.0], 2), (3, [2.0e5, -7.25], 2), (4, [1e9, 1.0], 3)]
    assert mined(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(100, [1e18, 1.0], 1), (1, [1e18, 0.5], 1)])


@pytest.mark.parametrize("dims", [1, 3, 16, 17, 64])
def test_bounds_hold(spark, dims):
    rng = np.random.default_rng(dims)
    values = np.round(rng.normal(size=(60, dims)) * rng.choice([1, 1000], (60, 1))).tolist()
    df = table(spark, [(k, v, 1) for k, v in enumerate(values)])
    stored = summarised(vectors(df, "vec_id", "embedding", F.col("label"), 1), dims)
    batch = stored.withColumn("limits", F.lit(None).cast("int")).coalesce(1).toArrow().combine_chunks().to_batches()[0]
    block = Block(batch, dims)
    exact = block.q @ block.q.T
    for level in (0, 1):
        low, high = bounds(block, block, level, slice(None))
        assert (low <= exact).all() and (exact <= high).all()
    means, deviations = summaries(block.q)
    if dims == 64:
        assert np.allclose(means[:, 4], block.q[:, :4].mean(axis=1)) and np.allclose(deviations[:, 4], block.q[:, :4].std(axis=1) * 2)
