"""Importance resampling: SQL on the driver's tables, plain Python, streams, odd rows."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import queries, resampling
from tests.test_queries import compare

SCHEMA = "doc_id long, text string, weight string, score string, rank string, bucket int, tie string, stream string"


def features(text, n):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, n=1, buckets=10_000, seed="2024", least=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, n)[1])
    t = Counter(bucket(f) for x in target for f in features(x, n)[1])
    all_s, all_t, rows = sum(s.values()), sum(t.values()), []
    for i, text in docs:
        words, fs = features(text, n)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in map(bucket, fs)]
        weight = math.floor(sum(gain) / len(gain)) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words) >= least])
    order = sorted((x for x in rows if x[5]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(order[: percent * len(order) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in rows), key=repr)


def drawn(docs, target, **options):
    found = resampling.resample(docs, target, **options)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, found.collect()), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZ09 -_'/:@[`{~\x7f\x00\n\téÉ漢😀İ "), max_size=60), st.integers(1, 3))
def test_buckets(text, n):
    words, fs = features(text, n)
    count, found = resampling.Buckets(n, 10_000).of(text.encode())
    assert count == len(words) and found.tolist() == [zlib.crc32(f.encode()) % 10_000 for f in fs]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=5), max_size=12))
def test_weights(docs):
    gain = np.array([-7, 3, 0, 12, -1, 5, 8, -20, 1, 2])
    offsets = np.cumsum([0, *map(len, docs)])
    stream = np.array([b for d in docs for b in d], np.uint16)
    assert resampling.weights(gain, stream, offsets).tolist() == [sum(gain[d]) // len(d) if d else 0 for d in docs]


def corpus(n):
    texts = [" ".join(f"w{(i * 7 + k * k) % 61}" for k in range(i % 60)) + " math Proof, " * (i % 4) for i in range(n)]
    return [(i, t) for i, t in enumerate(texts)], ["proof of math w1", "the math é", None]


@pytest.mark.parametrize("options", [{"n": 1}, {"n": 2}, {"n": 3, "buckets": 97, "seed": "x", "least_words": 5, "percent": 33}, {"n": 1, "percent": 100}, {"n": 1, "percent": 0}])
def test_plain(spark, options):
    docs, target = corpus(700)
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame([(t,) for t in target], "text string")
    want = {"least" if k == "least_words" else k: v for k, v in options.items()}
    assert drawn(*frames, **options) == plain(docs, target, **want)


def test_streams_of_bounded_size(spark, monkeypatch):
    docs, target = corpus(300)
    docs.append((300, "long " * 50_000))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    monkeypatch.setattr(resampling, "STREAM", 500)
    made = resampling.streams(frames[0].coalesce(1), "doc_id", "text", 1, 10_000)
    sizes = sorted(len(r["stream"]) for r in made.collect())
    assert len(sizes) > 20 and sizes[-2] < 700 and sizes[-1] >= 100_000
    assert drawn(*frames, n=1) == plain(docs, target)
    assert sum(r["n"] for r in resampling.sort_count(made).collect()) == sum(len(features(t, 1)[1]) for _, t in docs)


def test_odd_rows(spark):
    long = " ".join(f"x{i % 9}" for i in range(40))
    docs = [(None, None), (1, ""), (2, " .,- "), (3, long), (3, long), (None, long), (None, long + " y"), (4, "ÉÉ é" * 30), (5, "A-B_c" * 30), (None, long)] + [(i, f"{long} z{i}") for i in range(10, 40)]
    frame = spark.createDataFrame([(*x, "a", "b", "c", 1, "d", "e") for x in docs], SCHEMA)
    target = spark.createDataFrame([("x1 x2", "q"), (None, "q"), ("", "q")], "text string, doc_id string")
    assert drawn(frame, target, n=1, percent=50) == plain(docs, ["x1 x2", None, ""], percent=50)
    empty = spark.createDataFrame([], SCHEMA)
    assert drawn(empty, target, n=1) == []
    assert drawn(frame, empty, n=1) == plain(docs, [])


def test_a_third_in_one_key(spark):
    """Rows equal in id and text: their scores are equal, and the ranks still are 1, 2, ..."""
    text = " ".join(f"w{i}" for i in range(25))
    docs = [(7, text)] * 400 + [(i, text) for i in range(1000, 1800)]
    got = drawn(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(text,)], "text string"), n=1, percent=60)
    assert got == plain(docs, [text], percent=60)


def test_query(spark):
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no driver tables")
    assert compare(spark, "op13", queries.QUERIES["op13_importance_resampling"], queries.ORACLES["op13_importance_resampling"], "/root/testdata/sf0.01")
