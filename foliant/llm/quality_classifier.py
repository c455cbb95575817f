"""Quality by co-training of two views.

The content view is a logistic regression on the text's words: shares of hashed lower-cased words and of hashed word
shapes (case, digits, marks), how varied the words are, and the share that repeat the word before. The metadata view is one on language, source, length and
layout: lines, line lengths, shares of white space, capitals, digits and marks. In each round both views score all
unlabelled documents, and those that a view is surest of join the training rows of the other. At the end each view is
calibrated on labelled rows that it was not fitted on (Platt), and the score of a document is the mean of both calibrated
logits, weighted by what each view tells about the held-out rows. A document is kept where that outweighs two to one (`even`)
for bad, not where the score is a half: among labels that are mostly good ones most bad documents would score above it.

The fit uses at most `most_labelled` labelled documents, the first by hash of doc_id. Of the unlabelled ones none is left
out of the rounds; what a view takes in a round is bounded: `share` of their number, counted up to `most_pool`, divided by
class and then by language and source as the sure documents are, but one at least of each class, language and source
that has any. All documents are scored, in whole.

Cases: null text is an empty one, null language or source a value of its own; labels without quality don't count, and
of several for one document the mean decides; without labels of both kinds nothing can be learned and all documents are
kept with a null score; an empty table gives no row. Very long texts and words are read in whole. Rows of one doc_id are scored each
by its own text, and a label of such an id teaches by one of them, the first by hash. A tie at the threshold is kept. The result has
the carried columns and quality_content, quality_metadata, quality_score, kept, which take the place of columns of these names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm._common import bound_batches, stash, utf8

WORDS, SHAPES, TAGS = 1536, 509, 24
DIM, META = WORDS + SHAPES + 3, 2 * TAGS + 9
OWN = 12
_SHAPE = bytes(ord("A") if 65 <= i <= 90 else ord("a") if 97 <= i <= 122 or i > 127 else ord("0") if 48 <= i <= 57 else i for i in range(256))
_RUN = re.compile(rb"(.)\1{2,}", re.DOTALL)
_CAPS, _DIGITS, _SPACES = (bytes(r) for r in (range(65, 91), range(48, 58), [32, *range(9, 14)]))
_MARKS = bytes(i for i in range(33, 127) if not chr(i).isalnum())
DECISION = ["quality_content", "quality_metadata", "quality_score", "kept"]


def slots(word: bytes) -> tuple[int, int]:
    """The features of a word: its own and its shape's, where runs of one kind are cut to two."""
    short = _RUN.sub(rb"\1\1", word.translate(_SHAPE))
    return xxhash.xxh32_intdigest(word.lower()) % WORDS, WORDS + xxhash.xxh32_intdigest(short) % SHAPES


def content(text: bytes, known: dict[bytes, tuple[int, int]] | None = None) -> np.ndarray:
    """Shares of words and shapes, how varied the words are, the share that repeat the word before, 1 for no words.

    known: the slots of words, which is added to.
    """
    out = np.zeros(DIM)
    words = text.split()
    if not words:
        out[-1] = 1
        return out
    known = {} if known is None else known
    if len(known) > 300_000:
        known.clear()
    distinct = Counter(words)
    for w in distinct:
        if w not in known:
            known[w] = slots(w)
    at = np.fromiter(chain.from_iterable(map(known.__getitem__, distinct)), np.int64, 2 * len(distinct))
    out[:-3] = np.bincount(at, np.repeat(np.fromiter(distinct.values(), float, len(distinct)), 2), DIM - 3) / len(words)
    out[-3:-1] = variety(words, distinct)
    return out


def variety(words: list[bytes], distinct: set[bytes] | Counter) -> tuple[float, float]:
    return np.log1p(len(distinct)) / np.log1p(len(words)), sum(map(eq, words, islice(words, 1, None))) / len(words)


def metadata(text: bytes, lang: str | None, source: str | None) -> np.ndarray:
    out = np.zeros(META)
    out[xxhash.xxh32_intdigest(f"l{lang}") % TAGS] = 1
    out[TAGS + xxhash.xxh32_intdigest(f"s{source}") % TAGS] = 1
    n, lines = len(text), text.count(b"\n") + 1
    share = lambda drop: (n - len(text.translate(None, drop))) / max(1, n)
    out[2 * TAGS :] = [np.log1p(n), np.log1p(lines), np.log1p(n / lines), share(_SPACES), share(_CAPS), share(_DIGITS), share(_MARKS), share(b"\n"), n == 0]
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class View:
    """Logistic regression on scaled features; a fitted one is a linear function of the raw features."""

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 250, decay: float = 3e-4) -> View:
        self.mean = x.mean(0, dtype=np.float64)
        squares = sum((np.square(x[i : i + 512], dtype=np.float64).sum(0) for i in range(0, len(x), 512)))
        spread = np.sqrt(np.maximum(squares / len(x) - self.mean**2, 0))
        self.scale = np.maximum(spread, 0.25 * spread.mean() + 1e-6)
        if x.shape[1] == DIM:
            self.scale[-3:] /= OWN  # else the many hashed features hide them
        z = np.ones((len(x), x.shape[1] + 1), np.float32)  # the one copy of the rows
        np.subtract(x, self.mean.astype(np.float32), out=z[:, :-1], casting="same_kind")
        z[:, :-1] /= self.scale.astype(np.float32)
        z /= np.float32(np.sqrt(z.shape[1]))
        weight = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum())).astype(np.float32)
        w, m, v = (np.zeros(z.shape[1], np.float32) for _ in range(3))
        for t in range(1, steps + 1):  # Adam on all rows
            g = z.T @ (weight * (sigmoid(z @ w) - y).astype(np.float32)) + decay * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w = w.astype(float) / np.sqrt(len(w))
        self.w = w[:-1] / self.scale
        self.b = w[-1] - float(self.mean @ self.w)
        self.a, self.c, self.worth, self.good = 1.0, 0.0, 1.0, 0.5
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.a * (x @ self.w + self.b) + self.c

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt's scaling by Newton steps, towards a = 1, c = 0 where rows are few or the view divides them fully."""
        if not len(y) or y.min() == y.max():
            return
        raw, t = x @ self.w + self.b, np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        z, p = np.c_[raw, np.ones(len(raw))], np.array([1.0, 0.0])
        for _ in range(30):
            q = sigmoid(z @ p)
            h = z.T @ (z * (q * (1 - q))[:, None]) + 1e-2 * np.eye(2)
            p = p - np.clip(np.linalg.solve(h, z.T @ (q - t) + 1e-2 * (p - [1, 0])), -2, 2)
        self.a, self.c = max(float(p[0]), 1e-3), float(p[1])
        q = np.clip(sigmoid(z @ [self.a, self.c]), 1e-6, 1 - 1e-6)
        self.good = prior = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
        least = -(prior * np.log(prior) + (1 - prior) * np.log(1 - prior))
        self.worth = max(0.02, 1 + float((y * np.log(q) + (1 - y) * np.log(1 - q)).mean()) / least)


def co_train(views: list[np.ndarray], y: np.ndarray, held: np.ndarray, surest: Callable, rounds: int = 3) -> list[View]:
    """Two fitted, calibrated views. views: features of the labelled rows; y: 0 or 1; held: rows kept for calibration.

    surest(models, good) -> for either view the features of what the other labels for it, and the labels.
    """
    own = [(x[~held], y[~held]) for x in views]
    models = [View().fit(*o) for o in own]
    for _ in range(rounds):
        more = surest(models, [o.mean() for _, o in own])
        own = [tuple(np.concatenate(both) for both in zip(o, m)) for o, m in zip(own, more)]
        models = [View().fit(*o) for o in own]
    for m, x in zip(models, views):
        m.calibrate(x[held], y[held])
    return models


def even(models: list[View] | None, favour: float = 2.0) -> float:
    """The score at which what the views say outweighs `favour` to one that a document is bad, whatever share of the labels is good.

    Calibrated scores carry the share of good rows they were calibrated on; where that is large, a document may look bad and
    still score above a half. Rejecting a good document counts as much as keeping `favour` bad ones.
    """
    if not models:
        return 0.5
    worth = [m.worth for m in models]
    share = sum(w * np.log(m.good / (1 - m.good)) for w, m in zip(worth, models)) / sum(worth)
    return float(sigmoid(share - np.log(favour)))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, key (of id, text, language and source), stratum (of language and source) and both views' features as packed numbers."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            ids, langs, sources = (batch.column(c).to_pylist() for c in ("doc_id", "lang", "source"))
            rows = []
            for i, t, a, b in zip(ids, utf8(batch.column("text")), langs, sources):
                x, m = content(t, known), metadata(t, a, b)
                at = np.flatnonzero(x)
                key = np.uint64(xxhash.xxh64_intdigest(t, xxhash.xxh64_intdigest(repr((i, a, b))))).astype(np.int64)
                rows.append((i, int(key), int(m[:TAGS].argmax() * TAGS + m[TAGS : 2 * TAGS].argmax()), at.astype("<u2").tobytes(), x[at].astype("<f4").tobytes(), m.astype("<f8").tobytes()))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "key", "stratum", "at", "x", "meta"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string"), F.col("source").cast("string")).mapInArrow(of, "doc_id long, key long, stratum int, at binary, x binary, meta binary")


def unpacked(at: list[bytes], x: list[bytes], meta: list[bytes]) -> list[np.ndarray]:
    """Both views' features of the rows."""
    rows = np.zeros((len(at), DIM), np.float32)
    for row, a, b in zip(rows, at, x):
        row[np.frombuffer(a, "<u2")] = np.frombuffer(b, "<f4")
    return [rows, np.frombuffer(b"".join(meta), "<f8").reshape(len(at), META)]


class Pool:
    """All unlabelled documents, of which each round takes the surest."""

    def __init__(self, seen: DataFrame, known: DataFrame, most: int, share: float = 0.1, sure: float = 0.95):
        self.seen, self.known, self.most, self.share, self.edge = seen, known.select("doc_id"), most, share, float(np.log(sure / (1 - sure)))
        self.taken: list[set[int]] = [set(), set()]

    def scored(self, models: list[View]) -> DataFrame:
        """key, stratum, taker (a view), z (the other one's logit) of each unlabelled document and view."""
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    views = unpacked(*(batch.column(c).to_pylist() for c in ("at", "x", "meta")))
                    zs = [pa.array(np.asarray(m.logit(x), float)) for m, x in zip(models, views)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "key", "stratum")), *zs], ["doc_id", "key", "stratum", "u", "v"])

        rows = self.seen.mapInArrow(of, "doc_id long, key long, stratum int, u double, v double").join(self.known, "doc_id", "left_anti")
        rows = stash(rows.select("key", "stratum", "u", "v"), "scored")
        return rows.select("key", "stratum", F.explode(F.array(F.struct(F.lit(1).alias("taker"), F.col("u").alias("z")), F.struct(F.lit(0).alias("taker"), F.col("v").alias("z")))).alias("e")).select("key", "stratum", "e.*")

    def surest(self, models: list[View], good: list[float]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For either view the features of what the other one is surest of, and its labels.

        Sure documents are counted by view, class, stratum and step, a quarter of a logit. Steps above that where the quota is
        met are taken whole; from that one twice what is missing comes, by hash, and the rest is cut here.
        """
        spark = self.seen.sparkSession
        rows = self.scored(models).withColumns({"label": (F.col("z") > 0).cast("int"), "step": F.least(F.floor((F.abs("z") - self.edge) * 4), F.lit(63)).cast("int")})
        counts = rows.groupBy("taker", "label", "stratum", F.greatest("step", F.lit(-1)).alias("step")).count().collect()
        n = sum(r["count"] for r in counts) // 2
        taken = spark.createDataFrame([(t, k) for t in (0, 1) for k in sorted(self.taken[t])], "taker int, key long")
        rows = rows.where("step >= 0").join(F.broadcast(taken), ["taker", "key"], "left_anti")
        if taken.count():
            counts = rows.groupBy("taker", "label", "stratum", "step").count().collect()
        steps: dict[tuple[int, int], dict[int, dict[int, int]]] = defaultdict(lambda: defaultdict(dict))
        for r in counts:
            if r["step"] >= 0:
                steps[r["taker"], r["label"]][r["stratum"]][r["step"]] = r["count"]
        quotas, cuts = {}, []
        for (taker, label), strata in sorted(steps.items()):
            most = max(1, round(self.share * (good[taker] if label else 1 - good[taker]) * min(n, self.most)))
            there = sum(sum(x.values()) for x in strata.values())
            for stratum, x in sorted(strata.items()):
                quota = left = min(sum(x.values()), max(1, most * sum(x.values()) // max(most, there)))
                quotas[taker, label, stratum] = quota
                for step in sorted(x, reverse=True):
                    if x[step] >= left:
                        cuts.append((taker, label, stratum, step, min(1.0, (2 * left + 20) / x[step])))
                        break
                    left -= x[step]
        best = defaultdict(list)
        if cuts:
            at = F.broadcast(spark.createDataFrame(cuts, "taker int, label int, stratum int, cut int, part double"))
            draw = F.pmod(F.xxhash64("key", F.lit("draw")), F.lit(1 << 20)) / (1 << 20)
            near = rows.join(at, ["taker", "label", "stratum"]).where((F.col("step") > F.col("cut")) | (F.col("step") == F.col("cut")) & (draw < F.col("part")))
            for r in near.select("taker", "label", "stratum", "key", F.abs("z").alias("z")).distinct().collect():
                best[r["taker"], r["label"], r["stratum"]].append((-r["z"], r["key"]))
        labels: list[dict[int, int]] = [{}, {}]
        for (taker, label, stratum), found in sorted(best.items()):
            labels[taker].update((key, label) for _, key in sorted(found)[: quotas[taker, label, stratum]])
        keys = sorted({*labels[0], *labels[1]})
        wanted = spark.createDataFrame([(k,) for k in keys], "key long")
        got = self.seen.join(F.broadcast(wanted), "key").dropDuplicates(["key"]).orderBy("key").collect()
        views = unpacked(*([r[c] for r in got] for c in ("at", "x", "meta")))
        out = []
        for taker in (0, 1):
            self.taken[taker] |= set(labels[taker])
            own = [i for i, r in enumerate(got) if r["key"] in labels[taker]]
            out.append((views[taker][own], np.array([labels[taker][got[i]["key"]] for i in own], float)))
        return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_labelled: int = 4000, most_pool: int = 4000, rounds: int = 3) -> list[View] | None:
    """The two views, or None where the labelled sample holds one kind only."""
    bound_batches(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("y"))
    seen = stash(features(docs), "features")
    order = F.xxhash64("doc_id", F.lit("sample"))
    ids = seen.select("doc_id").where("doc_id is not null").distinct()
    sample = stash(ids.join(known, "doc_id").orderBy(order, "doc_id").limit(most_labelled), "sample")
    first = F.min_by(F.struct(*(c for c in seen.columns if c != "doc_id"), "y"), "key").alias("row")  # of rows with one id always the same one
    rows = seen.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(first).select("doc_id", "row.*").orderBy("doc_id").collect()
    y = np.array([r["y"] for r in rows], float)
    if len({*y}) < 2:
        return None
    views = unpacked(*([r[c] for r in rows] for c in ("at", "x", "meta")))
    held = np.array([xxhash.xxh32_intdigest(str(r["doc_id"])) % 4 == 0 for r in rows])
    if len({*y[~held]}) < 2:
        held[:] = False
    return co_train(views, y, held, Pool(seen, known, most_pool).surest, rounds)


def score(docs: DataFrame, models: list[View] | None, carry: list[str], threshold: float = 0.5, only_kept: bool = False) -> DataFrame:
    """The carried columns with the decision of each document, or only the kept rows' carried columns."""
    bound_batches(docs.sparkSession)
    carry = [c for c in carry if only_kept or c not in DECISION]
    fields = [f for f in docs.select(carry).schema.fields]
    own = [] if only_kept else [T.StructField(c, T.DoubleType()) for c in DECISION[:3]] + [T.StructField("kept", T.BooleanType())]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: dict[bytes, float] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            head = batch.select(range(len(carry)))
            text, lang, source = (batch.column(len(carry) + i) for i in range(3))
            if models:
                a, b = models
                total = a.worth + b.worth
                logits = []
                for t, g, s in zip(utf8(text), lang.to_pylist(), source.to_pylist()):
                    words = t.split()
                    distinct = set(words)
                    if len(weights) > 300_000:
                        weights.clear()
                    for w in distinct:
                        if w not in weights:
                            i, j = slots(w)
                            weights[w] = a.w[i] + a.w[j]
                    n = len(words)
                    x = a.b + (sum(map(weights.__getitem__, words)) / n + float(a.w[-3:-1] @ variety(words, distinct)) if n else a.w[-1])
                    logits.append((a.a * x + a.c, float(b.logit(metadata(t, g, s)))))
                u, v = np.array(logits).T
                views = [sigmoid(u), sigmoid(v), sigmoid((a.worth * u + b.worth * v) / total)]
                kept = views[2] >= threshold
                scores = [pa.array(x, pa.float64()) for x in views]
            else:
                kept = np.ones(batch.num_rows, bool)
                scores = [pa.nulls(batch.num_rows, pa.float64())] * 3
            if only_kept:
                yield head.filter(pa.array(kept))
            else:
                yield pa.RecordBatch.from_arrays([*head.columns, *scores, pa.array(kept)], [*carry, *DECISION])

    needed = [F.col(f"`{c}`") for c in carry] + [F.col(c).cast("string").alias(f"_in_{c}") for c in ("text", "lang", "source")]
    return docs.select(needed).mapInArrow(of, T.StructType(fields + own))


def classify(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, threshold: float | None = None, only_kept: bool = False, favour: float = 2.0, **fit) -> DataFrame:
    """Train on the labelled and the surest unlabelled documents, and score all; without a threshold `even` sets it."""
    models = train(docs, labels, **fit)
    return score(docs, models, carry if carry is not None else docs.columns, even(models, favour) if threshold is None else threshold, only_kept)
