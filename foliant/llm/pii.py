"""Personal data: fixed patterns, and bootstrapped contextual extraction of what they miss.

The fixed patterns (email, ip, card, phone) find the seeds, leftmost and without overlap by kind, in whole texts. All
are written so that Java's matcher runs in linear time and bounded stack: runs are possessive, and a run starts only
where its characters do or where the last match ended.

Bootstrapping works on the graph of lexical patterns and values. Candidates, all outside seeds, are tokens with an @; addresses
of four dotted numbers or of three to eight groups of hexadecimal digits with colons; runs of 7 to 19 digits with up to three
spaces, brackets, dots or hyphens between digits; and, as what speaks against a pattern, other tokens of [A-Za-z0-9._%+@-] with
four digits or more. The shape of a candidate allows kinds, or none. Each seed and candidate stands in up to three patterns: the
word before it, the two words before, and the word before with the word after. Words are whole, lower-cased, digits as 0, and
reach back to the match before and on to the next.

In each round a pattern scores, for a kind, what its known values of that kind weigh (seeds 1, accepted values their
score) by all that speaks on it: known values of any kind, candidates whose shape doesn't allow the kind, `doubt` for each doubted
candidate, and half a value more. The number of open candidates says nothing by itself: seeds may be few among many that only the
context tells. In a pattern a candidate is doubted for a kind while it stands there within a foreign pattern too: one with `support` open candidates or more and no known value of that
kind. So where a word stands before identifiers and before other numbers alike, the longer patterns around the others speak against it.
A pattern with score `sure` and `support` known values accepts its open candidates, at its score;
what a round accepts is known in the next one, and so brings in the patterns it stands in elsewhere. Rounds end when one accepts the same values at the same
scores as the one before, or after `rounds`: patterns that only a longer chain of accepted values would reach are then left out. An accepted value is marked
wherever it stands as a candidate. Scores are whole millionths, so sums don't depend on their order.

Rows are told apart by their place while the operator runs. Values and patterns are kept as hashes only. Every count is over distinct
(pattern, value), reduced before the shuffle; joins are between written tables, of which a small one is sent to all tasks and a
large one can be split where one pattern or value is in a third of all rows.

Cases: null and empty texts have no spans; a very long text may hold any number of spans, and a word of any length is one; repeated
rows each get a row and count once as values; of two kinds with the same score for a value the first listed is taken; an empty table
gives no row; further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm._common import let, small_side, stash

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: A chain of labels: atomic groups in groups, so that the matcher's stack stays low for any number of them.
_LABELS = r"(?:(?>(?:(?>(?:\.[A-Za-z0-9-]++){1,64})){1,64}))+"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++{_LABELS}",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_OTHER = "A-Za-z._%+@-"
#: Tokens with four digits; addresses of any domain; dotted and colon addresses; numbers in groups.
TOKEN = rf"(?<![0-9{_OTHER}])(?:[{_OTHER}]*+[0-9]){{4}}[0-9{_OTHER}]*+"
MAIL = r"(?<![\p{L}\p{N}._%+@-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}](?:[\p{L}\p{N}._-]*[\p{L}\p{N}])?(?![\p{L}\p{N}@])"
HOST = r"(?<![\p{L}0-9._%+@:-])(?:[0-9]++(?:\.[0-9]++){3}(?![.-]?[\p{L}0-9_%+@])|[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{0,4}+){2,7}(?![:.-]?[\p{L}0-9_%+@]))"
_INNER = "[ ().-]{0,3}"
NUMBER = rf"(?<![0-9]{_INNER})(?:(?<![\p{{L}}0-9_%+@])\((?=[0-9]{{1,6}}\))|(?<![\p{{L}}0-9._%+@-]))[0-9](?:{_INNER}[0-9]){{6,18}}(?!{_INNER}[0-9])(?!-?[\p{{L}}_%+@])"
#: The last two words of what stands before, read backwards, and the first one of what follows.
_WS, _NOT = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
LAST_WORDS = rf"^{_WS}*+({_NOT}++)(?:{_WS}++({_NOT}++))?"
FIRST_WORD = rf"^{_WS}*+({_NOT}++)"
SPAN = "array<struct<kind:int,s:int,e:int,v:string,w1:string,w2:string,after:string>>"
MILLION = 1_000_000


def luhn(v: Column) -> Column:
    digits = F.reverse(F.split(F.regexp_replace(v, "[ -]", ""), ""))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return luhn(v)
    if kind == "phone":
        return F.char_length(F.regexp_replace(v, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def fits(kind: str):
    return lambda x: valid(kind, x["v"])


def matches(text: Column, pattern: str, kind: int) -> Column:
    """All matches with their places, the two words before (the last one first, each reversed) and the word after.

    Places are running sums over the pieces between matches and the matches, gathered as a string: appending to an
    array would copy it element by element.
    """

    def placed(both: Column) -> Column:
        gap, v = both["gap"], both["v"]
        pairs = F.zip_with(F.slice(gap, 1, F.size(v)), v, lambda g, x: F.struct(F.char_length(g).alias("g"), F.char_length(x).alias("n")))
        zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        sums = F.aggregate(pairs, zero, lambda acc, x: F.struct((acc["at"] + x["g"] + x["n"]).alias("at"), F.concat(acc["out"], (acc["at"] + x["g"]).cast("string"), F.lit(",")).alias("out")), lambda acc: acc["out"])

        def spans(starts: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                s = F.get(starts, i).cast("int")
                back, on = F.reverse(F.get(gap, i)), F.get(gap, i + 1)
                words = [F.regexp_extract(back, LAST_WORDS, 1), F.regexp_extract(back, LAST_WORDS, 2), F.regexp_extract(on, FIRST_WORD, 1)]
                return F.struct(F.lit(kind).alias("kind"), s.alias("s"), (s + F.char_length(x)).alias("e"), x.alias("v"), *(w.alias(n) for w, n in zip(words, ("w1", "w2", "after"))))

            return F.transform(v, one)

        return F.when(F.size(v) > 0, let(F.split(sums, ","), spans)).otherwise(F.array().cast(SPAN))

    return let(F.struct(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("v")), placed)


#: What a text must hold for a pattern to be tried at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}


def seeds(text: Column) -> Column:
    none = F.array().cast(SPAN)
    found = []
    for k, kind in enumerate(KINDS):
        hit = F.filter(matches(text, PATTERNS[kind], k), fits(kind))
        found.append(F.when(text.rlike(HINTS[kind]), hit).otherwise(none))
    return F.concat(*found)


def candidates(text: Column, base: Column) -> Column:
    """Addresses, numbers in groups and other identifier-like tokens; none touches a seed or another."""

    def found(hint: str, pattern: str) -> Column:
        return F.when(text.rlike(hint), matches(text, pattern, -1)).otherwise(F.array().cast(SPAN))

    def clear(spans: Column, of: Column) -> Column:
        return F.filter(spans, lambda x: ~F.exists(of, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))

    sets = [
        F.concat(found("@", MAIL), found(r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f:]", HOST)),
        found(rf"[0-9](?:{_INNER}[0-9]){{6}}", NUMBER),
        found(rf"[0-9](?:[{_OTHER}]*+[0-9]){{3}}", TOKEN),
    ]
    first = clear(sets[0], base)
    return let(first, lambda a: let(F.concat(a, clear(clear(sets[1], base), a)), lambda b: F.concat(b, clear(clear(sets[2], base), b))))


def patterns(span: Column) -> Column:
    """Hashes of the span's lexical patterns: words lower-cased, digits as 0."""

    def plain(word: Column) -> Column:
        return F.when(word != "", F.regexp_replace(F.lower(word), "[0-9]+", "0"))

    def of(w: Column) -> Column:
        one, two, after = w["one"], w["two"], w["after"]
        return F.array_compact(F.array(F.when(one.isNotNull(), F.xxhash64(F.lit(1), one)), F.when(two.isNotNull(), F.xxhash64(F.lit(2), two, one)), F.when(one.isNotNull() & after.isNotNull(), F.xxhash64(F.lit(3), one, after))))

    return let(F.struct(plain(span["w1"]).alias("one"), plain(span["w2"]).alias("two"), plain(span["after"]).alias("after")), of)


def allowed(v: Column) -> Column:
    """The kinds that a candidate's shape allows."""
    digits = F.char_length(F.regexp_replace(v, "[^0-9]", ""))
    host = v.rlike(r"^[0-9]+(?:\.[0-9]+){3}$") | v.rlike("^[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}$")
    return F.array_compact(F.array(F.when(v.rlike("^[^@]+@[^@]+$"), 0), F.when(host, 1), F.when(v.rlike("^[0-9 -]+$") & digits.between(12, 19), 2), F.when(v.rlike("^[+0-9 ().-]+$") & digits.between(7, 15), 3)))


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, base (kind, s, e of seeds) and marks: value hash, patterns, kinds and place of seeds and candidates."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    based = rows.withColumn("base", seeds(F.col("t")))
    seen = based.withColumn("cand", candidates(F.col("t"), F.col("base")))

    def mark(x: Column, seed: bool) -> Column:
        kinds = F.array(x["kind"]) if seed else allowed(x["v"])
        return F.struct(F.xxhash64(x["v"]).alias("v"), patterns(x).alias("p"), kinds.alias("kinds"), F.lit(seed).alias("seed"), x["s"].alias("s"), x["e"].alias("e"))

    marks = F.concat(F.transform("base", lambda x: mark(x, True)), F.transform("cand", lambda x: mark(x, False)))
    return seen.select("doc_id", F.transform("base", lambda x: F.struct(x["kind"], x["s"], x["e"])).alias("base"), marks.alias("marks"))


def bootstrap(marks: DataFrame, rounds: int = 6, sure: float = 0.8, support: int = 5, doubt: float = 1.0) -> DataFrame:
    """(v, kind, score) of the accepted values. marks: p (the patterns of a place), v, kinds, seed."""
    edges = stash(marks.select(F.explode("p").alias("p"), "v", "kinds", "seed").distinct(), "edges")
    beside = marks.where("not seed").select(F.explode("p").alias("p"), F.col("p").alias("_all"), "v", "kinds").select("p", F.explode("_all").alias("q"), "v", F.explode("kinds").alias("kind"))
    beside = stash(beside.where("p <> q").distinct(), "beside")  # two patterns of one place
    seeded = edges.where("seed").select("p", F.col("kinds")[0].alias("kind"), "v").distinct().groupBy("p", "kind").agg(F.count(F.lit(1)).alias("n"))
    open_ = edges.where("not seed").select("p", "v", "kinds").distinct()
    total = open_.groupBy("p").agg(F.count(F.lit(1)).alias("all_open"))
    graph = stash(open_.select("p", "v", F.explode("kinds").alias("kind")), "graph")
    shaped = graph.groupBy("p", "kind").agg(F.count(F.lit(1)).alias("shaped"))
    by_kind = F.when(F.col("other") == F.col("kind"), F.col("n"))
    others = shaped.join(seeded.withColumnRenamed("kind", "other"), "p", "left").groupBy("p", "kind").agg(F.max("shaped").alias("shaped"), F.coalesce(F.max(by_kind), F.lit(0)).alias("seeds"), F.coalesce(F.sum("n"), F.lit(0)).alias("all_seeds"))
    fixed = stash(others.join(total, "p").select("p", "kind", "seeds", "all_seeds", (F.col("all_open") - F.col("shaped")).alias("misfits")), "patterns")
    spark = marks.sparkSession
    accepted, last = spark.createDataFrame([], "v long, kind int, score long"), None
    for _ in range(rounds):
        known = accepted.select("v", F.col("kind").alias("_kind"), "score")
        mine = F.col("_kind") == F.col("kind")
        told = graph.join(small_side(known), "v", "left").groupBy("p", "kind").agg(
            F.coalesce(F.sum(F.when(mine, F.col("score"))), F.lit(0)).alias("more"), F.count(F.when(mine, 1)).alias("n_more"), F.count(F.when(~mine, 1)).alias("against"), F.count(F.when(F.col("_kind").isNull(), 1)).alias("left")
        )
        told = stash(fixed.join(small_side(told), ["p", "kind"]), "told")
        n_known = F.col("seeds") + F.col("n_more")
        live = stash(told.where(n_known >= support), "live")
        foreign = stash(told.where((n_known == 0) & (F.col("left") >= support)).select(F.col("p").alias("q"), "kind"), "foreign")
        doubted = beside.join(small_side(live.select("p", "kind")), ["p", "kind"], "left_semi").join(small_side(foreign), ["q", "kind"], "left_semi").join(small_side(known.select("v")), "v", "left_anti")
        doubts = stash(doubted.select("p", "kind", "v").distinct().groupBy("p", "kind").agg(F.count(F.lit(1)).alias("doubted")), "doubts")
        weight = F.col("seeds") + F.col("more") / MILLION
        score = weight / (F.col("all_seeds") + F.col("more") / MILLION + F.col("against") + F.col("misfits") + doubt * F.coalesce("doubted", F.lit(0)) + 0.5)
        scored = live.join(small_side(doubts), ["p", "kind"], "left").select("p", "kind", F.round(score * MILLION).cast("long").alias("score"))
        good = stash(scored.where(F.col("score") >= round(sure * MILLION)), "good")
        best = F.max_by("kind", F.struct("score", -F.col("kind")))
        accepted = stash(graph.join(small_side(good), ["p", "kind"]).groupBy("v").agg(best.alias("kind"), F.max("score").alias("score")), "accepted")
        now = accepted.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(F.lit(1), "v", "kind", "score")), F.bit_xor(F.xxhash64(F.lit(2), "v", "kind", "score"))).first()  # tells sets apart
        if now == last or not now[0]:
            break
        last = now
    return accepted


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, by kind as listed, then start."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"], x["e"])), ",")


def of_kind(k: int):
    return lambda x: x["kind"] == k


def personal_data(docs: DataFrame, rounds: int = 6, sure: float = 0.8, support: int = 5, doubt: float = 1.0) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the seeds, spans with those found too, and n_found, their number."""
    rows = stash(extract(docs).withColumn("uid", F.monotonically_increasing_id()), "spans")
    marks = rows.select("uid", F.explode("marks").alias("m")).select("uid", "m.*")
    accepted = bootstrap(marks, rounds, sure, support, doubt)
    hits = marks.where("not seed").select("uid", "v", "s", "e").join(small_side(accepted.select("v", "kind")), "v")
    found = hits.groupBy("uid").agg(F.collect_list(F.struct("kind", "s", "e")).alias("found"))  # spans of one document
    out = rows.select("uid", "doc_id", "base").join(small_side(stash(found, "found")), "uid", "left")
    none = F.array().cast("array<struct<kind:int,s:int,e:int>>")
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", F.coalesce("found", none))).alias("spans"), F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_found"))
