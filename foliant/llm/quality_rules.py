"""Quality rules: a threshold table compiled into one projection over each whole text.

Counts come from the text alone and stay in its row: no shuffle, no user function. Words are runs of characters other
than space and U+0009 to U+000D. A word counts as repeated when it lies in a window of three words whose hash (64 bits,
of the words' own hashes) occurs twice or more in the text.

Cases: null and empty texts have no words and fail the base rule on the number of words; a very long text is measured in whole, its
windows sorted within the row; a measure that equals its threshold passes; further columns are left out;
repeated rows each get a row; an empty table gives none; a document without a doc_id gets a row with a null doc_id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm._common import WORD, let

SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he this are or at from have an they which "
    "le la les de des du et en un une que qui dans pour sur par est pas avec au "
    "der die das und in den von zu mit sich auf für ist im dem nicht ein eine als auch es an "
    "el los las y que del se por con una para su al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure must lie within [least, most], where given; of_words: only for texts of so many words at least."""

    measure: str
    least: float | None = None
    most: float | None = None
    of_words: int = 1


#: Measures are columns of `measures` or ratios of them, as in RATIOS.
RULES = (
    Rule("n_words", most=1_000_000),
    Rule("word_length", least=2, most=15),
    Rule("symbol_ratio", most=0.2),
    Rule("stop_word_ratio", least=0.02),
    Rule("dup_line_ratio", most=0.5),
    Rule("repeat_word_ratio", most=0.5),
)
RATIOS = {
    "word_length": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_word_ratio": ("n_repeat_words", "n_words"),
}


def repeat_words(h: Column, n: Column) -> Column:
    """Words, by the array h of their hashes, that lie in a window of three that occurs twice or more."""

    def covered(sorted_windows: Column) -> Column:
        def of(at: Column) -> Column:
            zero = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))
            return F.aggregate(at, zero, lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(p, acc["end"])).alias("n"), (p + 3).alias("end")), lambda acc: acc["n"])

        near = lambda x, i: F.get(sorted_windows, i)["h"].eqNullSafe(x["h"])
        again = F.transform(F.filter(sorted_windows, lambda x, i: near(x, i - 1) | near(x, i + 1)), lambda x: x["i"])
        return let(F.array_sort(again), of)

    def count(windows: Column) -> Column:
        numbered = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(numbered, covered))

    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))
    return F.when(n < 4, 0).otherwise(let(windows, count)).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules can name."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    parts = text.select("doc_id", "t", F.split(F.regexp_replace("t", r"[\x09-\x0D]", " "), " ").alias("parts"))
    hashed = parts.select("doc_id", "t", (F.size("parts") - 1).alias("spaces"), F.transform(F.array_remove("parts", ""), lambda w: F.xxhash64(w)).alias("h"))
    held = hashed.withColumns({"n": F.size("h"), "lines": F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))})
    stop = [F.xxhash64(F.lit(w)) for s in STOP_WORDS for w in (s, s.capitalize())]
    return held.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        (F.char_length("t") - F.col("spaces")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("h"), F.col("n")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("h", lambda x: x.isin(stop))).cast("long").alias("n_stop_words"),
    )


def compiled(rules: tuple[Rule, ...]) -> Column:
    """One condition from the whole table."""
    passed = F.lit(True)
    for r in rules:
        if r.measure in RATIOS:
            a, b = RATIOS[r.measure]
            value = F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
        else:
            value = F.col(r.measure)
        fits = F.lit(True)
        if r.least is not None:
            fits &= value >= r.least
        if r.most is not None:
            fits &= value <= r.most
        passed &= (F.col("n_words") < r.of_words) | fits
    return passed


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measures with base_failed and kept."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rest = ["n_lines", "n_stop_words"]
    return measures(docs).select(*names, base.alias("base_failed"), (~base & compiled(rules)).alias("kept"), *rest)
