"""Lines of word-processor paragraphs, made of the items of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import docx_lines
from foliant.plans.registry import query
from foliant.plans.tracker_queries import read


def paragraphs(spark, sf_dir):
    """Each order as a document, each of its items as a paragraph: a heading, a list's, a typed bullet's, a tabbed or a plain one.

    Items are brought together by order before texts are made of them, so that texts aren't shuffled; the number of partitions is given, since
    the keys alone are few bytes and would be put into few.
    """
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber").cast("long") * 10_000_000_000 + F.col("l_partkey") * 100 + F.col("l_quantity").cast("long")
    kind = F.pmod(F.col("l_partkey"), F.lit(7))
    mark = F.when(kind == 1, "• ").when(kind == 2, "– ").when(kind == 3, "o  Then ").otherwise("")
    words = F.repeat(F.lit("Shipped goods "), q)
    text = F.when(kind == 6, F.concat(F.lit("ORDER"), F.repeat(F.lit(" X"), q % 4))).otherwise(F.concat(mark, words, F.lit("by day"), q.cast("string")))
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return items.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey").select(
        F.col("l_orderkey").alias("doc_id"), n.alias("para_no"), text.alias("text"), F.when(kind == 6, 1 + q % 8).otherwise(0).alias("outline_level"), (q % 5 == 0).alias("bold"), (q % 3 == 0).alias("italic"),
        (F.lit(9.0) + q % 4).alias("size"), ((q % 3) * 6.0).alias("indent_pt"), F.when(kind == 4, q % 4).otherwise(-1).alias("list_level"), F.when(kind == 5, F.array(F.lit(100.0), q * 11.0)).otherwise(F.array().cast("array<double>")).alias("tab_stops"),
        (F.pmod(F.col("l_orderkey"), F.lit(3)) == 0).alias("in_table"), F.when(F.pmod(F.col("l_orderkey"), F.lit(3)) == 0, q % 2).otherwise(0).alias("table_col"),
    )


@query("""WITH i AS (SELECT l_orderkey AS doc_id, l_linenumber::BIGINT * 10000000000 + l_partkey * 100 + l_quantity::BIGINT AS para_no, l_quantity::INT AS q, l_partkey % 7 AS kind FROM lineitem),
p AS (SELECT *, CASE WHEN kind = 6 THEN 'ORDER' || repeat(' X', q % 4) ELSE CASE kind WHEN 3 THEN 'Then ' ELSE '' END || repeat('Shipped goods ', q) || 'by day' || q END AS text,
  CASE kind WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 0 END AS cut, CASE kind WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 0 END AS typed, CASE WHEN kind = 6 THEN 1 + q % 8 ELSE 0 END AS outline, 9.0::DOUBLE + q % 4 AS base_size,
  (q % 3) * 6.0::DOUBLE AS indent_pt, CASE WHEN kind = 4 THEN q % 4 ELSE -1 END AS list_level, CASE WHEN kind = 5 THEN greatest(100.0::DOUBLE, q * 11.0::DOUBLE) ELSE 0 END AS stop, CASE WHEN doc_id % 3 = 0 THEN q % 2 ELSE 0 END AS table_col FROM i),
c AS (SELECT *, CASE WHEN doc_id % 3 = 0 AND min(table_col) OVER d <> max(table_col) OVER d THEN table_col ELSE 0 END AS col, lag(outline) OVER (PARTITION BY doc_id ORDER BY para_no) > 0 AS after_heading,
  CASE WHEN list_level >= 0 THEN least(2, list_level + 1) ELSE typed END AS level, CASE outline WHEN 1 THEN 20.0 WHEN 2 THEN 15.0 WHEN 3 THEN 13.0 WHEN 4 THEN 12.0 WHEN 5 THEN 11.0 WHEN 6 THEN 11.0 ELSE base_size END::DOUBLE AS size FROM p WINDOW d AS (PARTITION BY doc_id)),
r AS (SELECT *, max(indent_pt + (length(text) + cut) * base_size * 0.5::DOUBLE) OVER (PARTITION BY doc_id, col) AS reach, min(CASE WHEN level > 0 THEN indent_pt END) OVER (PARTITION BY doc_id) AS least_, max(CASE WHEN level > 0 THEN indent_pt END) OVER (PARTITION BY doc_id) AS most_ FROM c),
n AS (SELECT *, list_level < 0 AND typed = 1 AND most_ - least_ >= 9 AND indent_pt >= least_ + 9 AS nested, indent_pt + CASE WHEN level > 1 THEN 12.0 ELSE 0.0 END::DOUBLE AS inner_ FROM r),
e AS (SELECT *, greatest(inner_ + length(text) * size * 0.5::DOUBLE, stop) AS edge, CASE WHEN nested THEN 12.0 ELSE 0.0 END::DOUBLE AS moved FROM n)
SELECT doc_id, para_no AS line_no, md5(text) AS text_md5, col::INT AS column, round(inner_ + moved, 2) AS x0, round(edge + moved, 2) AS x1, size, q % 5 = 0 OR outline > 0 AS bold, level > 0 AS bullet, CASE WHEN nested THEN 2 ELSE level END::INT AS bullet_level,
  CASE WHEN outline > 0 THEN 1.5 WHEN after_heading THEN 1.0 ELSE 0.0 END::DOUBLE AS gap_before, upper(text) = text AS all_caps, edge >= reach - greatest(10.0::DOUBLE, size * 4.5::DOUBLE) AS fills_width FROM e""")
def paragraph_lines(spark, sf_dir):
    """Lines of every order's paragraphs."""
    found = docx_lines.paragraph_lines(paragraphs(spark, sf_dir))
    return found.select("doc_id", "line_no", F.md5("text").alias("text_md5"), F.col("column").cast("int").alias("column"), "x0", "x1", "size", "bold", "bullet", F.col("bullet_level").cast("int").alias("bullet_level"), "gap_before", "all_caps", "fills_width")
