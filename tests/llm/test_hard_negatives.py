"""Hard negatives: SQL on the driver's table, brute force, intervals, odd rows."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import hard_negatives, queries
from tests.test_queries import compare

SCHEMA = "vec_id long, label int, embedding array<float>, id long, q string, rank int, anchor string"


def brute(rows, positives=5, negatives=5, low=80, high=100, scale=256, every=100):
    """Each pair's product in plain Python."""
    part = []
    for vec_id, label, vector in rows:
        if None not in (vec_id, label, vector) and all(x is not None and np.isfinite(x) for x in vector):
            part.append((vec_id, label, [int(np.floor(scale * float(np.float32(x)))) for x in vector]))
    out = []
    for a, la, qa in part:
        if a % every:
            continue
        by = sorted((-sum(x * y for x, y in zip(qa, q)), i, label) for i, label, q in part if i != a)
        for ps, p, _ in [x for x in by if x[2] == la][:positives]:
            fits = [(-ns, n) for ns, n, label in by if label != la and -low * ps <= -100 * ns <= -high * ps][:negatives]
            out += [(a, p, k + 1, n, -ps, ns) for k, (ns, n) in enumerate(fits)]
    return sorted(out)


def mined(frame, **options):
    found = hard_negatives.mine(frame, vec_id="vec_id", label="label", vector="embedding", anchor=F.col("id") % 100 == 0, **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def rows_of(seed, n, dims, labels, spread=0.3):
    """Vectors around one centre for each label, with ties."""
    r = np.random.default_rng(seed)
    centres = r.normal(0, 0.5, (labels, dims))
    rows = []
    for i in range(n):
        label = int(r.integers(labels))
        vector = (centres[label] + r.normal(0, spread, dims) + centres.mean(0)).astype(np.float32).tolist()
        rows.append((i, label, rows[i - 3][2] if i % 11 == 0 and i > 3 else vector))
    return rows


@pytest.mark.parametrize("seed, n, dims, labels", [(1, 900, 16, 3), (2, 2500, 64, 5), (3, 400, 1, 2), (4, 700, 9, 1)])
def test_brute_force(spark, seed, n, dims, labels):
    rows = rows_of(seed, n, dims, labels)
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5)
    want = brute(rows)
    assert mined(frame) == want
    assert bool(want) == (labels > 1)


def test_groups_of_anchors(spark):
    rows = rows_of(5, 1500, 8, 4)
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert mined(frame, group_bytes=1500) == brute(rows)
    assert mined(frame, positives=2, negatives=7, low=50, high=90) == brute(rows, 2, 7, 50, 90)


def test_many_copies(spark):
    """A third of the rows are one vector: ties by the smaller id, over many blocks."""
    rows = rows_of(6, 3000, 8, 3)
    rows = [(i, label, rows[0][2] if i % 3 == 0 else v) for i, label, v in rows]
    assert mined(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(7)) == brute(rows)


def test_large_and_small_components(spark):
    r = random.Random(3)
    rows = [(i, i % 2, [r.choice([0.0, -1e-9, 1e4, -3e3, 0.5, 7.25]) for _ in range(6)]) for i in range(300)]
    assert mined(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")) == brute(rows)
    huge = spark.createDataFrame([(0, 1, [1e30]), (1, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    with pytest.raises(Exception, match="fit in a long"):
        mined(huge)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = rows_of(7, 500, 4, 3)
    rows += [(None, 1, [0.1] * 4), (600, None, [0.1] * 4), (700, 1, None), (800, 1, [0.1, None, 0.1, 0.1]), (900, 2, [nan] * 4), (1000, 2, [inf, 0.1, 0.1, 0.1]), (1100, 2, [0.0] * 4), (1200, 1, [-0.2] * 4)]
    odd = [(*x, 5, "x", 1, "y") for x in rows]
    assert mined(spark.createDataFrame(odd, SCHEMA)) == brute(rows)
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(7, 1, [1.0], *[None] * 4)], SCHEMA)) == []
    short = [(0, 1, [0.5, 0.5]), (1, 1, [0.5]), (2, 2, [0.5, 0.4, 9.0]), (3, 2, []), (4, 1, [0.5, 0.5, 3.0])]
    assert mined(spark.createDataFrame(short, "vec_id long, label int, embedding array<float>")) == brute([(i, la, v + [0.0] * (3 - len(v))) for i, la, v in short])
    twice = [(0, 1, [1.0]), (1, 1, [0.9]), (1, 1, [0.9]), (2, 2, [0.85]), (2, 2, [0.85]), (100, 1, [1.0])]
    assert mined(spark.createDataFrame(twice, "vec_id long, label int, embedding array<float>")) == brute(twice)


def test_intervals_hold_and_drop(monkeypatch):
    """Every pair that is left has its exact score, none that belongs to the result is dropped, and most never see the last planes."""
    r = np.random.default_rng(8)
    q, a = np.round(r.normal(0, 32, (1024, 64))).astype(np.int64), np.round(r.normal(0, 32, (40, 64))).astype(np.int64)
    n, planes = hard_negatives.slice_bits(q)
    block = hard_negatives.Block.read(1024, 64, n, np.arange(1024).tobytes(), np.zeros(1024, np.int64).tobytes(), planes)
    assert ((block.planes.astype(np.int64) * (1 << np.arange(n)[::-1])[:, None, None]).sum(0) - (1 << n - 1) == q).all()
    score = a @ q.T
    least = np.sort(score, axis=1)[:, -5:-4]
    anchors = hard_negatives.Anchors(-1 - np.arange(40), np.zeros(40, np.int64), a, least, np.full((40, 1), 2**62))
    taken = []
    whole = np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, x, y: taken.append(len(x)) or whole(how, x, y))
    i, j, s = hard_negatives.First(anchors, True, 5).qualify(block)
    assert (s == score[i, j]).all() and {*zip(i.tolist(), j.tolist())} == {*zip(*(x.tolist() for x in np.nonzero(score >= least)))}
    assert taken and taken[0] < 0.1 * score.size and taken[-1] < 0.02 * score.size


def test_query(spark):
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no driver tables")
    assert compare(spark, "op11", queries.QUERIES["op11_hard_negatives"], queries.ORACLES["op11_hard_negatives"], "/root/testdata/sf0.01")
