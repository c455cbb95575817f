"""Text, keyword, skill and posting queries: documents stand in for resumes, benchmark for postings' texts, pages for job pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import lines, matching, postings, taxonomy
from foliant.plans.registry import query
from foliant.plans.tracker_queries import read


def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "text")


@query("""SELECT doc_id, regexp_replace(regexp_extract(text, '[A-Za-z0-9._%+''-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,24}'), '[.,;]+$', '') AS email
FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+''-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,24}')""")
def text_email(spark, sf_dir):
    return docs(spark, sf_dir).where(F.contains("text", F.lit("@"))).select("doc_id", X.find_email(F.col("text")).alias("email")).where("email <> ''")


@query("""SELECT doc_id, md5(trim(regexp_replace(text, '[ \\x0B-\\x0D]+', ' ', 'g'), E' \\t\\n')) AS normal FROM documents""")
def text_normalise(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(X.normalise(F.col("text"))).alias("normal"))


_LINES = """WITH r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
t AS (SELECT doc_id, line_no, trim(x) AS raw FROM r), g AS (SELECT *, CASE WHEN lag(raw) OVER (PARTITION BY doc_id ORDER BY line_no) = '' THEN 1.0 ELSE 0.0 END::DOUBLE AS gap_before FROM t),
l AS (SELECT *, CASE WHEN regexp_matches(raw, '^[•▪●■‣❋❖]') THEN 1 WHEN regexp_matches(raw, '^[◦○□⁃∙·–—*+]') THEN 2 WHEN regexp_matches(raw, '^[-‐]\\s+') THEN 2
WHEN regexp_matches(raw, '^o(\\t+| {2,}| [A-Z(])') AND length(raw) > 12 THEN 2 WHEN regexp_matches(raw, '^(\\(?[0-9]{1,2}[.)]|\\(?[a-z][.)])\\s+') AND length(raw) > 12 THEN 1 ELSE 0 END AS bullet_level FROM g WHERE raw <> ''),
b AS (SELECT *, trim(CASE WHEN bullet_level = 0 THEN raw ELSE regexp_replace(raw, '^([•▪●■‣❋❖◦○□⁃∙·–—*+]|[-‐]\\s+|o(\\t+| )|\\(?[0-9]{1,2}[.)]\\s+|\\(?[a-z][.)]\\s+)\\s*', '') END) AS body FROM l)
"""


@query(_LINES + """SELECT doc_id, line_no::INT AS line_no, md5(regexp_replace(body, ' +', ' ', 'g')) AS text_md5, bullet_level, gap_before, (body = upper(body) AND lower(body) <> upper(body)) AS all_caps FROM b WHERE body <> ''""")
def text_lines(spark, sf_dir):
    return lines.text_lines(docs(spark, sf_dir)).select("doc_id", "line_no", F.md5("text").alias("text_md5"), "bullet_level", "gap_before", "all_caps")


@query(_LINES + """SELECT doc_id, 1::BIGINT AS pages, count(*) AS lines, sum(length(regexp_replace(body, ' +', ' ', 'g')))::BIGINT AS characters,
sum(len(list_filter(string_split(body, ' '), lambda w: w <> '')))::BIGINT AS words, count(*) FILTER (bullet_level > 0) AS bullets, 1::BIGINT AS columns FROM b WHERE body <> '' GROUP BY doc_id""")
def parse_stats(spark, sf_dir):
    return lines.line_stats(lines.text_lines(docs(spark, sf_dir)))


@query("""WITH r AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM conversations),
k AS (SELECT *, lower(trim(x)) AS key FROM r WHERE trim(x) <> ''),
o AS (SELECT conv_id, key FROM k WHERE length(key) < 70 GROUP BY ALL HAVING count(DISTINCT turn) >= 3)
SELECT conv_id, count(*) AS kept FROM k ANTI JOIN o USING (conv_id, key)
WHERE NOT regexp_matches(trim(x), '^[-–—\\s]*[0-9]{1,3}[-–—\\s]*$') GROUP BY conv_id""")
def page_furniture(spark, sf_dir):
    """Lines that stand on three pages or more go; a conversation's turns stand in for a document's pages."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("text"))
    return lines.drop_furniture(rows, doc=("conv_id",), page="turn").groupBy("conv_id").agg(F.count(F.lit(1)).alias("kept"))


_STOP = ", ".join(f"'{w}'" for w in matching.STOPWORDS)
_KEYWORDS = f"""WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+.#/-]{{1,}}')) AS word,
generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+.#/-]{{1,}}'), 1) AS pos FROM benchmark),
c AS (SELECT item_id, word, count(*) AS n, min(pos) AS first FROM t WHERE length(word) >= 3 AND word NOT IN ({_STOP}) AND NOT regexp_matches(word, '^[0-9]+$') GROUP BY ALL),
k AS (SELECT item_id, word, n, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, first)::INT AS rank FROM c QUALIFY rank <= 40)
"""


@query(_KEYWORDS + "SELECT item_id, word, n, rank FROM k")
def posting_keywords(spark, sf_dir):
    return matching.keywords(read(spark, sf_dir, "benchmark"), "item_id")


def _covered(spark, sf_dir):
    lists = matching.keyword_lists(matching.keywords(read(spark, sf_dir, "benchmark"), "item_id"), "item_id")
    rows = docs(spark, sf_dir).withColumn("mr", matching.metric_ratio(F.col("text")))
    return matching.coverage(rows, lists, "item_id", carry=("mr",))


_COVERED = _KEYWORDS + """, m AS (SELECT doc_id, item_id, count(*)::INT AS n_words, count(*) FILTER (contains(lower(text), word))::INT AS n_matched,
count(*) FILTER (rank <= 20 AND contains(lower(text), word))::INT AS n_top FROM documents CROSS JOIN k GROUP BY ALL)
"""


@query(_COVERED + "SELECT * FROM m")
def keyword_coverage(spark, sf_dir):
    return _covered(spark, sf_dir).drop("mr")


@query(_COVERED + """, x AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda y: trim(y)), lambda y: y <> '') AS ls FROM documents),
r AS (SELECT doc_id, CASE WHEN len(ls) > 0 THEN len(list_filter(ls, lambda y: regexp_matches(y, '[0-9]'))) / len(ls) ELSE 0.0 END::DOUBLE AS mr FROM x),
s AS (SELECT doc_id, item_id, floor(greatest(0.0::DOUBLE, least(100.0::DOUBLE, (n_matched / n_words * 0.55::DOUBLE + least(1.0::DOUBLE, n_top / least(n_words, 20)) * 0.20::DOUBLE + 0.0::DOUBLE * 0.15::DOUBLE + mr * 0.10::DOUBLE) * 100)) + 0.5::DOUBLE)::INT AS score
FROM m JOIN r USING (doc_id))
SELECT doc_id, item_id, score, CASE WHEN score >= 75 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS level FROM s""")
def ats_score(spark, sf_dir):
    """Texts without fields: completeness is 0."""
    scored = _covered(spark, sf_dir).select("doc_id", "item_id", matching.ats_score(F.col("n_matched"), F.col("n_words"), F.col("n_top"), F.lit(0.0), F.col("mr")).alias("score"))
    return scored.withColumn("level", matching.ats_level(F.col("score")))


#: Terms of the invented prose, as a taxonomy to detect and to match by.
TERMS = ["The", "And", "token", "idiot", "Die", "Les", "Los", "That", "With", "For it", "In the", "Of"]


def _term_sql(column: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({column}, '(?i)(?:^|[^a-zA-Z0-9]){t}(?:$|[^a-zA-Z0-9])') THEN '{t}' END" for t in TERMS) + "], lambda s: s IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string({_term_sql('text')}, '|') AS skills FROM documents")
def detect_skills(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(matching.detect_skills(F.col("text"), TERMS), "|").alias("skills"))


@query(f"""WITH r AS (SELECT DISTINCT doc_id AS resume_id, lower(unnest({_term_sql('text')})) AS k FROM documents), p AS (SELECT item_id AS posting_id, lower(unnest({_term_sql('text')})) AS k FROM benchmark),
t AS (SELECT posting_id, count(*) AS total FROM p GROUP BY 1)
SELECT resume_id, posting_id, total, count(*) AS matched, floor(100 * count(*) / total + 0.5)::INT AS percent FROM p JOIN r USING (k) JOIN t USING (posting_id) GROUP BY resume_id, posting_id, total""")
def skill_match(spark, sf_dir):
    has = docs(spark, sf_dir).select(F.col("doc_id").alias("resume_id"), F.explode(matching.detect_skills(F.col("text"), TERMS)).alias("skill"))
    wants = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("posting_id"), F.explode(matching.detect_skills(F.col("text"), TERMS)).alias("skill"))
    return matching.skill_match(has, wants)


_STRIP = r"""trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>', '', 'g'), '(?i)<br\b[^>]*>', chr(10), 'g'),
'(?i)</(li|p|div|tr|h1|h2|h3|h4|h5|h6)\s*>', chr(10), 'g'), '(?s)<[a-zA-Z/!][^>]*>', '', 'g'),
'&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', chr(160)), '&amp;', '&'),
'[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), E' \n\t\r')"""


@query(f"SELECT page_id, md5({_STRIP}) AS text_md5, length({_STRIP})::INT AS n_chars FROM pages")
def strip_html(spark, sf_dir):
    plain = read(spark, sf_dir, "pages").select("page_id", postings.strip_html(F.col("html")).alias("t"))
    return plain.select("page_id", F.md5("t").alias("text_md5"), F.char_length("t").alias("n_chars"))


@query(rf"""WITH p AS (SELECT page_id, {_STRIP} AS t FROM pages)
SELECT page_id, concat_ws('|', CASE WHEN regexp_matches(t, '(?i)\bdental\b') THEN 'Dental' END, CASE WHEN regexp_matches(t, '(?i)\bvision\b') THEN 'Vision' END, CASE WHEN regexp_matches(t, '(?i)\bhybrid\b') THEN 'Hybrid' END) AS highlights,
regexp_extract(t, '(?i)\b[0-9]{{1,2}}\+?\s*(?:(?:to|-|–|—)\s*[0-9]{{1,2}}\s*)?years?\b') AS years, regexp_extract(t, '(?i)\b(Senior|Junior|Mid[- ]?level|Entry[- ]?level|Lead|Principal|Staff)\b', 1) AS seniority FROM p""")
def posting_signals(spark, sf_dir):
    plain = read(spark, sf_dir, "pages").select("page_id", postings.strip_html(F.col("html")).alias("t"))
    return plain.select("page_id", F.array_join(postings.highlights(F.col("t")), "|").alias("highlights"), postings.experience_years(F.col("t")).alias("years"), postings.seniority(F.col("t")).alias("seniority"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
'\$[0-9,]+(\.[0-9]+)?\s*[kKmMbB]?\+?', '', 'g'), '\b[0-9][0-9,]*(\.[0-9]+)?\s*%', '', 'g'), '\b[0-9][0-9,]*(\.[0-9]+)?\s*(x|X)\b', '', 'g'),
'(?i)\b[0-9][0-9,]*(\.[0-9]+)?\+?\s*(users?|customers?|clients?|engineers?|members?|teams?|hours?|days?|weeks?|months?|years?|projects?|releases?|deployments?|servers?|nodes?|requests?|incidents?|tickets?)\b', '\1', 'g'),
'\s{2,}', ' ', 'g'), '\s+([.,;])', '\1', 'g'), '\(\s*\)', '', 'g'), E' \n\t\r')) AS stripped FROM documents""")
def strip_metrics(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(X.strip_metrics(F.col("text"))).alias("stripped"))


@query("""WITH o AS (SELECT a.conv_id, a.turn, list_filter(string_split(a.text, ' '), lambda w: NOT list_contains(list_transform(string_split(b.text, ' '), lambda v: lower(v)), lower(w))) AS removed,
list_filter(string_split(b.text, ' '), lambda w: NOT list_contains(list_transform(string_split(a.text, ' '), lambda v: lower(v)), lower(w))) AS added
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn) SELECT conv_id, turn, md5(array_to_string(added, ' ')) AS added, md5(array_to_string(removed, ' ')) AS removed FROM o""")
def skills_diff(spark, sf_dir):
    """Entries before and after: the words of a turn and of the next one."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ").alias("old"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("old").alias("new"))
    added, removed = matching.skills_changed(F.col("old"), F.col("new"))
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.md5(F.array_join(added, " ")).alias("added"), F.md5(F.array_join(removed, " ")).alias("removed"))


#: Terms out of the conversations: pairs and triples of neighbouring words as they stand there, words with the mark behind them, and strict ones.
_TAKEN = ("[A-Za-z]+[^A-Za-z0-9]+[A-Za-z]+", "[A-Za-z]+[^A-Za-z0-9]+[A-Za-z]+[^A-Za-z0-9]+[A-Za-z]+", "[A-Za-z]+[^A-Za-z0-9\\s]")
_STRICT = ("Of", "The", "De")


def taxonomy_of_conversations(spark, sf_dir):
    each = (F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in _TAKEN)
    taken = read(spark, sf_dir, "conversations").select(F.explode(F.concat(*each)).alias("term"), F.lit(False).alias("strict"))  # with repeats, which the index sums
    return taken.unionAll(spark.range(1).select(F.explode(F.array(*map(F.lit, _STRICT))).alias("term"), F.lit(True).alias("strict")))


@query(rf"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_TAKEN[0]}') || regexp_extract_all(text, '{_TAKEN[1]}') || regexp_extract_all(text, '{_TAKEN[2]}')) AS term FROM conversations),
k AS (SELECT DISTINCT term, lower(term) AS low FROM t),
d AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS w, regexp_split_to_array(text, '[A-Za-z0-9]+') AS s FROM documents),
p AS (SELECT doc_id, unnest(range(len(w))) + 1 AS i, w, s FROM d),
r AS (SELECT doc_id, i - 1 AS pos, lower(w[i] || s[i + 1] || w[i + 1]) AS low FROM p WHERE i + 1 <= len(w)
  UNION ALL SELECT doc_id, i - 1, lower(w[i] || s[i + 1] || w[i + 1] || s[i + 2] || w[i + 2]) FROM p WHERE i + 2 <= len(w)
  UNION ALL SELECT doc_id, i - 1, lower(w[i] || s[i + 1][1]) FROM p WHERE length(s[i + 1]) > 1 OR length(s[i + 1]) = 1 AND i = len(w)),
x AS (SELECT doc_id, term, count(*) AS n_found, min(pos) AS first_pos FROM r JOIN k USING (low) GROUP BY ALL),
y AS (SELECT doc_id, z.term, p.i - 1 AS pos FROM p, (VALUES {", ".join(f"('{t}')" for t in _STRICT)}) AS z(term) WHERE lower(w[i]) = lower(z.term)
  AND regexp_matches(s[i], CASE WHEN i = 1 THEN '^$|^\s*$|[
,;:/|()]\s*$' ELSE '[
,;:/|()]\s*$' END)
  AND regexp_matches(s[i + 1], CASE WHEN i = len(w) THEN '^\s*$|^\s*[
,;:/|()]' ELSE '^\s*[
,;:/|()]' END))
SELECT doc_id, term, n_found::BIGINT AS n_found, first_pos::INT AS first_pos FROM x UNION ALL SELECT doc_id, term, count(*)::BIGINT, min(pos)::INT FROM y GROUP BY ALL""")
def taxonomy_terms(spark, sf_dir):
    """Every document's terms of a taxonomy of tens of thousands, with their number and first place."""
    return taxonomy.find_terms(docs(spark, sf_dir), taxonomy_of_conversations(spark, sf_dir), strict="strict")
