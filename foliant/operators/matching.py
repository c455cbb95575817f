"""Keywords, coverage scores and skill matches between two sets of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import text as X
from foliant.operators.tracker import js_round

# Words that are no keyword of a posting.
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "if", "then", "for", "of", "to", "in", "on", "with", "at", "by", "from", "as", "is", "are", "was", "were", "be", "been", "being", "this", "that",
    "these", "those", "you", "your", "we", "our", "they", "their", "it", "its", "will", "can", "may", "must", "should", "have", "has", "had", "do", "does", "did", "not", "no", "yes", "who",
    "what", "which", "when", "where", "how", "why", "into", "about", "than", "also", "etc", "including", "other", "such", "all", "any", "per", "via", "using", "use", "used", "across",
    "within", "role", "job", "work", "years", "year", "experience", "experienced", "team", "teams", "ability", "strong", "excellent", "company", "looking", "preferred", "required",
    "requirements", "responsibilities", "candidate", "candidates", "plus", "well",
)
TOKEN = "[a-z0-9][a-z0-9+.#/-]{1,}"

# Spellings of one skill.
SKILL_ALIASES = {
    "js": "javascript", "ts": "typescript", "k8s": "kubernetes", "gcp": "google cloud platform", "google cloud": "google cloud platform",
    "aws": "amazon web services", "ml": "machine learning", "nlp": "natural language processing", "postgres": "postgresql", "mongo": "mongodb",
    "node": "node.js", "nodejs": "node.js", "golang": "go", "dotnet": ".net", "cicd": "ci/cd", "ci cd": "ci/cd", "ms office": "microsoft office",
    "gsuite": "google workspace", "google suite": "google workspace", "crm software": "crm", "ppt": "powerpoint", "microsoft powerpoint": "powerpoint",
    "ux": "ux design", "user experience design": "ux design", "ui": "ui design", "user interface design": "ui design",
}


def keywords(postings: DataFrame, key: str, text: str = "text", most: int = 40) -> DataFrame:
    """key, word, n, rank: the most frequent words, ties by first place in the text."""
    tokens = postings.select(key, F.posexplode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))).alias("pos", "word"))
    fit = tokens.where((F.char_length("word") >= 3) & ~F.col("word").isin(*STOPWORDS) & ~F.col("word").rlike("^[0-9]+$"))
    counted = fit.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), "first")))
    return ranked.where(F.col("rank") <= most).select(key, "word", "n", "rank")


def keyword_lists(words: DataFrame, key: str) -> DataFrame:
    """key, words: each posting's keywords in order of rank."""
    packed = words.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("w"))
    return packed.select(key, F.transform("w", lambda x: x["word"]).alias("words"))


def coverage(resumes: DataFrame, postings: DataFrame, key: str, doc: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), posting_bytes: int = 8_000_000) -> DataFrame:
    """doc, the carried columns, key, n_words, n_matched, n_top: how many of a posting's keywords (and of its first 20) a text holds.

    Every text meets every posting: that is the question. The postings' keyword lists travel to the texts in groups of
    at most posting_bytes. A text is read once for each group: an automaton of all its distinct keywords finds those that the text
    holds, and each posting's are counted among them.
    """
    spark = resumes.sparkSession
    lists = postings.select(key, "words")
    size = lists.agg(F.sum(F.octet_length(F.array_join("words", ",")))).first()[0] or 0
    groups = 1 + size // posting_bytes
    rows = resumes.select(doc, *carry, F.lower(F.coalesce(text, F.lit(""))).alias("_text"))
    head = rows.schema.fields[:-1]
    schema = T.StructType([*head, lists.schema[key], *(T.StructField(c, T.IntegerType()) for c in ("n_words", "n_matched", "n_top"))])
    out = None
    for k in range(groups):
        part = lists.where(F.pmod(F.xxhash64(key), F.lit(groups)) == k) if groups > 1 else lists
        shared = spark.sparkContext.broadcast([(r[key], list(r["words"])) for r in part.orderBy(key).collect()])

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            found, number = ahocorasick.Automaton(), {}
            for _, words in shared.value:
                for w in words:
                    if w and w not in number:
                        found.add_word(w, number.setdefault(w, len(number)))
            found.make_automaton()
            own = [np.array([number[w] for w in words if w], np.int64) for _, words in shared.value]
            keys, sizes = pa.array([x for x, _ in shared.value]), np.array([len(w) for _, w in shared.value], np.int32)
            flat = np.concatenate([*own, np.empty(0, np.int64)])
            posting = np.repeat(np.arange(len(own)), [len(o) for o in own])
            place = np.concatenate([*(np.arange(len(o)) for o in own), np.empty(0, np.int64)])
            first = flat[place < 20], posting[place < 20]
            n = len(own)
            for batch in batches if n else ():
                texts = batch.column(batch.num_columns - 1).to_pylist()
                for at in range(0, len(texts), 500):
                    some = texts[at : at + 500]
                    matched, top = np.zeros((2, len(some), n), np.int32)
                    for i, t in enumerate(some):
                        hit = np.zeros(len(number), np.int32)
                        hit[list({x for _, x in found.iter(t)}) if number else []] = 1
                        matched[i] = np.bincount(posting, hit[flat], n)
                        top[i] = np.bincount(first[1], hit[first[0]], n)
                    docs = pa.array(np.repeat(np.arange(at, at + len(some)), n))
                    heads = [c.take(docs) for c in batch.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*heads, keys.take(pa.array(np.tile(np.arange(n), len(some)))), pa.array(np.tile(sizes, len(some))), pa.array(matched.ravel()), pa.array(top.ravel())], schema.names)

        here = rows.mapInArrow(count, schema)
        out = here if out is None else out.unionAll(here)
    return out


def ats_score(matched: Column, n: Column, top: Column, completeness: Column, metric_ratio: Column) -> Column:
    """0 to 100: 55 % coverage, 20 % of the first 20 keywords, 15 % completeness, 10 % lines with figures; 0 for no keywords' text."""
    share = F.when(n > 0, matched / n).otherwise(0.0)
    first = F.when(n > 0, top / F.least(n, F.lit(20))).otherwise(0.0)
    raw = share * 0.55 + F.least(F.lit(1.0), first) * 0.20 + completeness * 0.15 + metric_ratio * 0.10
    return js_round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 100))).cast("int")


def ats_level(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 50, "medium").otherwise("low")


def metric_ratio(text: Column) -> Column:
    """The share of lines that hold a digit."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: X.strip(x)), lambda x: x != "")
    return F.when(F.size(lines) > 0, F.size(F.filter(lines, lambda x: x.rlike("[0-9]"))) / F.size(lines)).otherwise(0.0)


def canonical_skill(c: Column) -> Column:
    norm = F.lower(X.clean_skill(c))
    alias = F.create_map(*(F.lit(x) for kv in SKILL_ALIASES.items() for x in kv))
    return F.coalesce(F.try_element_at(alias, norm), norm)


def skill_match(resume_skills: DataFrame, posting_skills: DataFrame) -> DataFrame:
    """resume_id, posting_id, total, matched, percent of the posting's skills that a resume has, for pairs that share one.

    Both sides have a row for each skill (resume_id or posting_id, skill); they meet on the canonical skill.
    """
    has = resume_skills.select("resume_id", canonical_skill(F.col("skill")).alias("k")).where("k <> ''").distinct()
    wants = posting_skills.select("posting_id", "skill", canonical_skill(F.col("skill")).alias("k"))
    total = posting_skills.groupBy("posting_id").agg(F.count(F.lit(1)).alias("total"))
    met = wants.where("k <> ''").join(has, "k").groupBy("resume_id", "posting_id").agg(F.count(F.lit(1)).alias("matched"))
    return met.join(total, "posting_id").select("resume_id", "posting_id", "total", "matched", js_round(100 * F.col("matched") / F.col("total")).cast("int").alias("percent"))


def term_pattern(term: str) -> str:
    """The term with no letter or digit on either side."""
    escaped = "".join("\\" + ch if ch in r".*+?^${}()|[]\\" else ch for ch in term)
    return rf"(?i)(?:^|[^a-zA-Z0-9]){escaped}(?:$|[^a-zA-Z0-9])"


def strict_pattern(term: str) -> str:
    """The term alone between the marks of a list."""
    return rf"(?im)(?:^|[\n,;:/|()])\s*{term}\s*(?:[\n,;:/|()]|$)"


#: Terms that a taxonomy may have: it goes into the plan.
MOST_TERMS = 5000


def detect_skills(text: Column, taxonomy: list[str], strict: tuple[str, ...] = ("Go", "R")) -> Column:
    """The terms of the taxonomy that a text names, in its order; `Go (golang)` counts as Go.

    A text is read once: its runs of letters and digits, one to as many in a row as a term has, are intersected with those of all
    terms, and only the terms that are left are looked for by their pattern.
    """
    terms = [t for t in dict.fromkeys(taxonomy) if re.search("[A-Za-z0-9]", t)]
    if len(terms) > MOST_TERMS:
        raise ValueError(f"a taxonomy of more than {MOST_TERMS} terms")
    if not terms:
        return F.array().cast("array<string>")
    runs = {t: re.findall("[a-z0-9]+", t.lower()) for t in terms}

    def pattern(t: str) -> str:
        alone = strict_pattern(t) if t in strict else term_pattern(t)
        return alone + (r"|\bGo\s*\(\s*golang\s*\)" if t == "Go" else "")

    table = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(" ".join(runs[t])).alias("key"), F.lit(pattern(t)).alias("p")) for t in terms))

    def named(words: Column) -> Column:
        found = []
        for n in sorted({len(r) for r in runs.values()}):
            keys = F.array(*(F.lit(k) for k in dict.fromkeys(" ".join(r) for r in runs.values() if len(r) == n)))
            inside = words if n == 1 else F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))
            found.append(F.array_intersect(inside, keys))
        return X.let(F.concat(*found), lambda keys: F.transform(F.filter(table, lambda t: F.array_contains(keys, t["key"]) & F.rlike(text, t["p"])), lambda t: t["t"]))

    return F.when(text.isNotNull(), X.let(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), named)).otherwise(F.array().cast("array<string>"))


def named_in_list(text: Column, term: str) -> Column:
    """The term stands next to a comma, semicolon, bar, slash or bullet, as an entry of a list does."""
    escaped = re.escape(term)
    return text.rlike(rf"(?i)(?:[,;|/•·]\s*{escaped}(?![a-zA-Z0-9]))|(?:(?<![a-zA-Z0-9]){escaped}\s*[,;|/•·])")


def guarded_skills(text: Column, taxonomy: list[str], ambiguous: tuple[str, ...] = ()) -> Column:
    """Detected terms, without ambiguous ones that stand in no list."""
    found = detect_skills(text, taxonomy)
    for term in ambiguous:
        found = F.when(named_in_list(text, term), found).otherwise(F.array_remove(found, term))
    return found


def matched_and_missing(wanted: Column, has: Column) -> tuple[Column, Column]:
    """The wanted skills that are there and those that aren't, in their own spelling and order; they meet on the canonical skill."""
    own = F.transform(has, canonical_skill)
    there = lambda x: F.array_contains(own, canonical_skill(x))
    return F.filter(wanted, there), F.filter(wanted, lambda x: ~there(x))


def skills_changed(old: Column, new: Column) -> tuple[Column, Column]:
    """Added and removed skills, whatever their case, in their own spelling and order."""
    lower = lambda xs: F.transform(xs, lambda x: F.lower(x))
    return F.filter(new, lambda x: ~F.array_contains(lower(old), F.lower(x))), F.filter(old, lambda x: ~F.array_contains(lower(new), F.lower(x)))


def dedupe_keep_first(xs: Column) -> Column:
    """Without later entries that differ by case alone."""
    lower = F.transform(xs, lambda x: F.lower(x))
    return F.filter(xs, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def loose_match(truth: DataFrame, parsed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, truth, parsed: each expected value with the first parsed one that equals it or holds it, or is held by it.

    truth has keys and value, parsed has keys, pos and value; both compare in small letters and digits alone.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    a = truth.select(*keys, F.col("value").alias("truth"), plain("value").alias("_a"))
    b = parsed.select(*keys, "pos", F.col("value").alias("parsed"), plain("value").alias("_b"))
    near = (F.col("_b") != "") & (F.contains("_a", F.col("_b")) | F.contains("_b", F.col("_a")))
    met = a.join(b, keys).where((F.col("_a") != "") & near)
    hit = met.groupBy(*keys, "truth").agg(F.min_by("parsed", "pos").alias("parsed"))
    return a.select(*keys, "truth").join(hit, [*keys, "truth"], "left")
