"""One query for each operator over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontamination, hard_negatives, line_dedup, mixing, packing, pii, quality_classifier, quality_rules, resampling, simhash, token_counts, token_shards, url_filter
from foliant.llm._common import stash, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after three edits of every document: a note put in, a passage taken out, an end replaced.

    The trees are built and kept in a table with their texts; the edits start from that table.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.char_length(F.coalesce("text", F.lit(""))).cast("long")

    def edit(start, end, new: str):
        return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(new).alias("replacement"))

    third, half = F.floor(n / 3), F.floor(n / 2)
    edits = F.array(edit(third, third, " [see note] "), edit(half, half + F.least(F.lit(40), F.floor(n / 8)), ""), edit(F.floor(n * 3 / 4), F.floor(n * 3 / 4) + 10, "as revised in this edition"))
    kept = stash(token_counts.build_trees(docs, carry=["text"]), "trees", compression="zstd")
    return token_counts.apply_edits(kept.withColumn("edits", edits), leaves=False, trees=True)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def pii_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What bootstrapping adds to the seeds, over notes made of the whole table customer: c_custkey, note, spans.

    Two in three notes give a number that the fixed patterns know; the others one without a country's code, which only the words
    around it tell; a second note gives these again in other words, and a fifth of the customers a number found in those words alone.
    The keys are spread over all tasks before notes are made of them: the table is a small file, or one row group, at any size.
    """
    key = F.col("c_custkey")
    seven = F.lpad(key.cast("string"), 7, "0")
    local = F.concat(F.lit("(0555) "), F.substring(seven, 1, 3), F.lit(" "), F.substring(seven, 4, 4))
    value = F.when(key % 3 < 2, F.concat(F.lit("+1 555 "), seven)).otherwise(local)
    notes = F.array(
        F.struct(F.lit(1).alias("note"), F.concat(F.lit("reach this customer under "), value, F.lit(" on weekdays")).alias("text")),
        F.struct(F.lit(2).alias("note"), F.when(key % 3 == 2, F.concat(F.lit("the hotline was "), local, F.lit(" before"))).alias("text")),
        F.struct(F.lit(3).alias("note"), F.when(key % 5 == 0, F.concat(F.lit("the hotline was 0777-"), seven, F.lit(" before"))).alias("text")),
        F.struct(F.lit(4).alias("note"), F.concat(F.lit("order 0888-"), seven, F.lit(" came")).alias("text")),
    )
    keys = table(spark, sf_dir, "customer").select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    rows = keys.select("c_custkey", F.explode(notes).alias("x")).select((key * 10 + F.col("x.note")).alias("doc_id"), F.col("x.text").alias("text"))
    found = pii.personal_data(rows)
    return found.select(F.floor(F.col("doc_id") / 10).alias("c_custkey"), (F.col("doc_id") % 10).alias("note"), "n_phone", "n_found", "spans")


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.token_shards(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts as their SHA-256."""
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "removed", F.sha2("text", 256).alias("text_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 100; every seventh row has another label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), vec_id="vec_id", label=label, vector="embedding", anchor=F.col("id") % 100 == 0)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is one part that bears loss, so its tokens and its segment are what limits it."""
    return packing.pieces(packing.pack(table(spark, sf_dir, "documents"), parts=packing.whole_text("text")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_quality_rules, op3_mixing, op4_url_filter, op5_quality_classifier, op6_pii, op7_token_shards, op8_decontamination, op9_line_dedup, op10_simhash, op11_hard_negatives, op12_packing, op13_importance_resampling, pii_discovery)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_FEATURES = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_STOP = ", ".join(f"'{w}'" for s in sorted(set(quality_rules.STOP_WORDS)) for w in dict.fromkeys((s, s.capitalize())))

ORACLES: dict[str, str] = {
    "op2_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
p AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT r, i, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, x, y, z) > 1 AND z IS NOT NULL AS again FROM g),
v AS (SELECT r, again OR coalesce(lag(again, 1) OVER o, false) OR coalesce(lag(again, 2) OVER o, false) AS hit FROM c WINDOW o AS (PARTITION BY r ORDER BY i)),
k AS (SELECT r, count(*) FILTER (hit) AS n_repeat_words FROM v GROUP BY r),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  len(lines)::BIGINT AS n_lines, len(list_filter(w, lambda x: x IN ({_STOP})))::BIGINT AS n_stop_words FROM l LEFT JOIN k USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words <= 1000000 AND word_chars / n_words BETWEEN 2 AND 15 AND n_symbols / n_words <= 0.2
  AND n_stop_words / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.5 AND n_repeat_words / n_words <= 0.5 AS kept, n_lines, n_stop_words FROM b""",
    "op3_mixing": rf"""
WITH e0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, text) - 1 AS no FROM documents),
d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':' || no || ':7'), 1, 7))::BIGINT % 4096 AS bin FROM e0),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS weight FROM s),
c AS (SELECT *, source_size * 3.0::DOUBLE AS cap FROM w),
a AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c WINDOW o AS (ORDER BY cap / weight, source IS NULL, source)),
x AS (SELECT *, max(CASE WHEN level * weight <= cap THEN level END) OVER () AS lev FROM a),
f AS (SELECT source, source_size, least(cap, coalesce(lev * weight, cap)) AS target,
  CASE WHEN source_size > 0 THEN floor(least(cap, coalesce(lev * weight, cap)) / source_size + 1e-12) ELSE 0 END::BIGINT AS whole FROM x),
b AS (SELECT source, bin, sum(size) AS words FROM d GROUP BY ALL),
e AS (SELECT source, bin + 1 AS edge, sum(words) OVER (PARTITION BY source ORDER BY bin) AS upto FROM b UNION ALL SELECT source, 0, 0 FROM s),
q AS (SELECT e.source, edge, row_number() OVER (PARTITION BY e.source ORDER BY abs(upto - (target - whole * source_size)), edge) AS k
  FROM e JOIN f ON e.source IS NOT DISTINCT FROM f.source),
t AS (SELECT d.doc_id, d.size, f.source_size, f.target, CASE WHEN d.size > 0 THEN whole + (bin < edge)::INT ELSE 0 END::BIGINT AS copies
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source JOIN q ON d.source IS NOT DISTINCT FROM q.source AND k = 1)
SELECT doc_id, size, source_size, target, copies, (copies * size)::BIGINT AS taken FROM t""",
    "pii_discovery": """
WITH n AS (SELECT c_custkey, unnest([1, 2, 3, 4])::BIGINT AS note FROM customer)
SELECT c_custkey, note, (note = 1 AND c_custkey % 3 < 2)::BIGINT AS n_phone,
  (note = 1 AND c_custkey % 3 = 2 OR note = 2 AND c_custkey % 3 = 2 OR note = 3 AND c_custkey % 5 = 0)::BIGINT AS n_found,
  CASE WHEN note = 1 AND c_custkey % 3 < 2 THEN 'phone:26:40' WHEN note = 1 THEN 'phone:26:41' WHEN note = 2 AND c_custkey % 3 = 2 THEN 'phone:16:31'
    WHEN note = 3 AND c_custkey % 5 = 0 THEN 'phone:16:28' ELSE '' END AS spans FROM n""",
    "op9_line_dedup": r"""
WITH e AS (SELECT doc_id, coalesce(text, '') AS t, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS th FROM documents),
d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, th) AS r, doc_id, t, string_split(t, chr(10)) AS l FROM e),
p AS (SELECT r, doc_id, t, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS pos FROM d),
g AS (SELECT *, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM p WINDOW o AS (PARTITION BY r ORDER BY pos)),
w AS (SELECT r, doc_id, t, pos, x, y, z FROM g WHERE z IS NOT NULL AND regexp_matches(x || y || z, '[^\x20\x09-\x0D]')),
k AS (SELECT r, pos, row_number() OVER (PARTITION BY x, y, z ORDER BY r, pos) AS n FROM w),
c AS (SELECT DISTINCT r, pos + s AS pos FROM k, (VALUES (0), (1), (2)) AS v(s) WHERE n > 1),
a AS (SELECT r, string_agg(pos, ',' ORDER BY pos) AS removed, count(*) AS n FROM c GROUP BY r),
b AS (SELECT r, string_agg(x, chr(10) ORDER BY pos) AS kept FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.r = p.r AND c.pos = p.pos) GROUP BY r)
SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(l) END::BIGINT AS n_lines, coalesce(a.n, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed,
  sha256(coalesce(kept, '')) AS text_sha256 FROM d LEFT JOIN a USING (r) LEFT JOIN b USING (r)""",
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    "op13_importance_resampling": rf"""
WITH k AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs),
d AS (SELECT row_number() OVER () AS r, doc_id, {_FEATURES} AS w FROM documents),
f AS (SELECT r, unnest(w) AS x FROM d),
g AS (SELECT unnest({_FEATURES}) AS x FROM benchmark),
u AS (SELECT DISTINCT x, hex(encode(x)) AS h FROM (SELECT x FROM f UNION ALL SELECT x FROM g)),
c AS (SELECT x, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
  lambda a, y: xor(a >> 8, crcs[(xor(a, y) & 255) + 1])), 4294967295) % 10000 AS b FROM u, k),
s AS (SELECT b, count(*) AS s FROM f JOIN c USING (x) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM g JOIN c USING (x) GROUP BY b),
z AS (SELECT (SELECT count(*) FROM f)::DOUBLE AS s_all, (SELECT count(*) FROM g)::DOUBLE AS t_all),
v AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + 10000) / ((s + 1.0::DOUBLE) * (t_all + 10000)))) AS gain FROM s LEFT JOIN t USING (b), z),
m AS (SELECT r, floor(sum(gain) / count(*))::BIGINT AS weight FROM f JOIN c USING (x) JOIN v USING (b) GROUP BY r),
e AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS long_enough,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN m USING (r)),
o AS (SELECT *, row_number() OVER (PARTITION BY long_enough ORDER BY score DESC, doc_id) AS place, 10 * count(*) FILTER (long_enough) OVER () // 100 AS drawn FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN long_enough AND place <= drawn THEN place END AS rank FROM o""",
}
