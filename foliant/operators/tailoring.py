"""Reviewable diffs of records and what they become under decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import WS, strip
from foliant.operators.tracker import js_round

ACTIONS = ("modify", "keep", "remove", "add")


def split_bullets(description: Column) -> Column:
    lines = F.transform(F.split(F.coalesce(description, F.lit("")), "\n"), lambda x: strip(F.regexp_replace(x, rf"^[{WS}]*[-•*][{WS}]*", "")))
    return F.filter(lines, lambda x: x != "")


def preprocessed(text: Column) -> Column:
    """A text for a model: without page marks, bullets as dashes, at most one empty line at a time, no blanks at line ends."""
    out = F.coalesce(text, F.lit(""))
    # Marks of pages, and the glyphs that become a dash.
    out = F.regexp_replace(out, r"(?i)--\s*[0-9]+\s*of\s*[0-9]+\s*--", "\n")
    out = F.regexp_replace(out, r"(?i)\bPage\s+[0-9]+\s*(of\s+[0-9]+)?\b", "")
    out = F.regexp_replace(out, r"(?m)^[•▪●✓✔►➢➳*▸]\s*", "- ")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    return strip(F.regexp_replace(out, "(?m)[ \t]+$", ""))


def keep_all(description: Column) -> Column:
    """A diff that changes nothing."""
    return F.transform(split_bullets(description), lambda b: F.struct(b.alias("old"), b.alias("new"), F.lit("keep").alias("action")))


def clean_bullets(bullets: Column) -> Column:
    """Bullets (old, new, action) with defaults: new falls back to old, an unknown action is modify."""
    text = lambda x: F.coalesce(x, F.lit(""))
    return F.transform(bullets, lambda b: F.struct(text(b["old"]).alias("old"), F.coalesce(b["new"], text(b["old"])).alias("new"), F.when(b["action"].isin(*ACTIONS), b["action"]).otherwise("modify").alias("action")))


def aligned(description: Column, rewritten: Column) -> Column:
    """Old and new lines side by side, for a rewritten block without alignment."""
    def one(x: Column) -> Column:
        old, new = x["old"], x["new"]
        action = F.when(new.isNotNull(), F.when(old.isNotNull(), "modify").otherwise("add")).otherwise("remove")
        return F.struct(F.coalesce(old, F.lit("")).alias("old"), F.coalesce(new, old).alias("new"), action.alias("action"))

    pairs = F.zip_with(split_bullets(description), split_bullets(rewritten), lambda a, b: F.struct(a.alias("old"), b.alias("new")))
    return F.transform(pairs, one)


def tailored(roles: DataFrame, answers: DataFrame) -> DataFrame:
    """roles (resume_id, index, role, company, description) with bullets from answers (resume_id, index, pos, bullets, description).

    Of several answers for one role the last counts; without one all lines are kept.
    """
    last = Window.partitionBy("resume_id", "index").orderBy(F.col("pos").desc())
    picked = answers.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("resume_id", "index", F.col("bullets").alias("_b"), F.col("description").alias("_d"))
    bullets = F.when(F.size(F.coalesce("_b", F.array())) > 0, clean_bullets(F.col("_b"))).when(F.col("_d").isNotNull(), aligned(F.col("description"), F.col("_d"))).otherwise(keep_all(F.col("description")))
    return roles.join(picked, ["resume_id", "index"], "left").select("resume_id", "index", "role", "company", bullets.alias("bullets"))


def projected(diff: DataFrame, decisions: DataFrame) -> DataFrame:
    """resume_id, index, description: each role's lines under the decisions (resume_id, index, bullet, accepted).

    What isn't decided is accepted. A removed line stays only if that is declined; a kept one is taken as it is; of others
    the new text is taken, or the old one (the new one where there is none) if declined.
    """
    rows = diff.select("resume_id", "index", F.posexplode("bullets").alias("bullet", "b"))
    met = rows.join(decisions.select("resume_id", "index", "bullet", "accepted"), ["resume_id", "index", "bullet"], "left")
    yes, b = F.coalesce("accepted", F.lit(True)), F.col("b")
    line = F.when(b["action"] == "remove", F.when(~yes, b["old"])).when(b["action"] == "keep", b["new"]).otherwise(F.when(yes, b["new"]).when(b["old"] != "", b["old"]).otherwise(b["new"]))
    packed = met.groupBy("resume_id", "index").agg(F.array_sort(F.collect_list(F.struct("bullet", line.alias("line")))).alias("x"))
    text = F.array_join(F.transform(F.filter("x", lambda x: x["line"].isNotNull()), lambda x: x["line"]), "\n")
    return diff.select("resume_id", "index").join(packed.select("resume_id", "index", text.alias("description")), ["resume_id", "index"], "left").select("resume_id", "index", F.coalesce("description", F.lit("")).alias("description"))


def accept_all(bullets: Column) -> Column:
    """The new lines of all bullets but removed ones."""
    return F.array_join(F.transform(F.filter(bullets, lambda b: b["action"] != "remove"), lambda b: F.when(b["new"] != "", b["new"]).otherwise(b["old"])), "\n")


def count_changes(bullets: Column) -> Column:
    return F.size(F.filter(bullets, lambda b: b["action"] != "keep"))


def clean_scores(before: Column, after: Column) -> Column:
    """Both scores as whole numbers from 0 to 100, after never below before; null stays null."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), js_round(x).cast("double"))).cast("int")
    a, b = F.when(before.isNotNull(), clamp(before)), F.when(after.isNotNull(), clamp(after))
    return F.struct(a.alias("before"), F.when(b < a, a).otherwise(b).alias("after"))


def compact_roles(roles: Column) -> Column:
    """The first 6 roles, with cut fields and up to 8 lines of up to 280 characters each."""
    cut = lambda x, n: F.substring(F.coalesce(x, F.lit("")), 1, n)

    def one(e: Column, i: Column) -> Column:
        lines = F.transform(F.split(F.coalesce(e["description"], F.lit("")), "[\n•]"), lambda b: F.substring(strip(F.regexp_replace(b, rf"[{WS}]+", " ")), 1, 280))
        return F.struct(i.alias("index"), cut(e["role"], 140).alias("role"), cut(e["company"], 140).alias("company"), cut(e["start_date"], 40).alias("start_date"), cut(e["end_date"], 40).alias("end_date"), F.slice(F.filter(lines, lambda b: b != ""), 1, 8).alias("bullets"))

    return F.transform(F.slice(roles, 1, 6), one)


def cache_key(*fields: Column) -> Column:
    return F.sha1(F.concat_ws(chr(1), *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)))


def merge_analysis(found: Column, base: Column) -> Column:
    """The outside analysis's list where it has entries, else the rules' own."""
    return F.when(F.size(F.coalesce(found, F.array().cast("array<string>"))) > 0, found).otherwise(base)
