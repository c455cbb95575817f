"""Queries over records, dates, replies, diffs, headings and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foliant.functions import dates, json_repair, sections
from foliant.operators import cleaning, lines, postings, records, scoring, tailoring
from foliant.plans.registry import query
from foliant.plans.text_queries import docs
from foliant.plans.tracker_queries import read
from foliant.sources import files
from foliant.sources.shared import shared_dir
from foliant.streaming import tracker as stream


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS iso, strftime(o_orderdate, '%b %Y') AS start, 'Present' AS "end", true AS current,
strftime(o_orderdate, '%b %Y') || ' – Present' AS label, 'Clerk' AS rest FROM orders""")
def date_ranges(spark, sf_dir):
    """A line with the order's month as a range."""
    line = F.concat(F.lit("Clerk, "), F.date_format("o_orderdate", "MMM yyyy"), F.lit(" - present"))
    found = read(spark, sf_dir, "orders").select("o_orderkey", dates.find_range(line).alias("r"), dates.strip_dates(line).alias("rest"))
    return found.select("o_orderkey", dates.iso(F.col("r.start")).alias("iso"), "r.start", "r.end", "r.current", dates.range_label(F.col("r.start"), F.col("r.end"), F.col("r.current")).alias("label"), "rest")


@query("""WITH o AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS told, count(DISTINCT o_orderpriority) AS k FROM orders GROUP BY 1),
s AS (SELECT c_custkey, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN 0.65::DOUBLE + told / n * 0.35::DOUBLE ELSE 0 END AS e, least(1.0::DOUBLE, coalesce(k, 0) / 8) AS sk, n_name IS NOT NULL AS place
FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, round_even((14 + CASE WHEN place THEN 6 ELSE 0 END + 4.0::DOUBLE + 20 * least(1.0::DOUBLE, e) + 12 * sk) / 100 * 100, 0)::INT AS overall, round_even(e * 100, 0)::INT AS experience,
concat_ws('|', 'education', 'email', 'linkedin', CASE WHEN NOT place THEN 'location' END, 'phone', CASE WHEN sk < 0.5 THEN 'skills' END, 'website', CASE WHEN e < 0.5 THEN 'work_experience' END) AS missing FROM s""")
def completeness_score(spark, sf_dir):
    """Customers as people, their orders as what they did."""
    done = F.struct(F.col("o_orderpriority").alias("company"), F.col("o_orderstatus").alias("position"), F.lit("1997").alias("start_date"), F.lit("").alias("end_date"), F.when(F.col("o_orderstatus") == "F", F.array(F.lit("done"))).otherwise(F.array().cast("array<string>")).alias("responsibilities"))
    held = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(done).alias("e"), F.countDistinct("o_orderpriority").alias("k"))
    people = read(spark, sf_dir, "customer").join(held, F.col("o_custkey") == F.col("c_custkey"), "left").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    none = F.lit("")
    place = F.struct(none.alias("city"), none.alias("state"), F.col("n_name").alias("country"))
    contact = F.struct(F.col("c_name").alias("name"), none.alias("email"), none.alias("phone"), place.alias("location"), none.alias("linkedin"), none.alias("website"))
    school = F.array().cast("array<struct<institution:string,degree:string>>")
    empty = F.array().cast("array<struct<company:string,position:string,start_date:string,end_date:string,responsibilities:array<string>>>")
    score = people.select("c_custkey", scoring.completeness(contact, F.lit("short"), F.coalesce("e", empty), school, F.coalesce("k", F.lit(0))).alias("s"))
    return score.select("c_custkey", "s.overall", F.col("s.fields")["work_experience"].alias("experience"), F.array_join("s.missing", "|").alias("missing"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name || ' at ' || p_brand || '. ' || CASE WHEN p_partkey % 3 = 1 THEN 'Key skills: ' || p_type || ', ' || p_name || '. ' ELSE '' END || p_brand END AS description FROM part""")
def made_descriptions(spark, sf_dir):
    """Parts as postings: with a description, without one but with skills, and with neither."""
    kind = F.col("p_partkey") % 3
    skills = F.when(kind == 1, F.array("p_type", F.lit(""), "p_name")).otherwise(F.array().cast("array<string>"))
    made = postings.description_or_made(F.when(kind == 0, F.concat(F.lit(" "), "p_type")).when(kind == 1, "  "), F.col("p_name"), F.col("p_brand"), skills, F.col("p_brand"))
    return read(spark, sf_dir, "part").select("p_partkey", made.alias("description"))


@query("""SELECT event_id, props AS repaired, '{"a": [' || props || ']}' AS cut FROM events""")
def json_replies(spark, sf_dir):
    """Fenced replies with prose behind them, and replies that break off inside a list."""
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n``` (as {asked})"))
    broken = F.concat(F.lit('{"a": ['), "props", F.lit(', {"b": "unfin'), F.lit("}"))
    return read(spark, sf_dir, "events").select("event_id", json_repair.repaired_json(fenced).alias("repaired"), json_repair.repaired_json(broken).alias("cut"))


@query("""WITH b AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'modify' WHEN turn = 1 THEN 'remove' ELSE 'keep' END AS action, coalesce(text, '') AS old, 'new ' || turn::VARCHAR AS new, turn >= 2 AS yes FROM conversations),
l AS (SELECT conv_id, turn, CASE WHEN action = 'remove' THEN CASE WHEN NOT yes THEN old END WHEN action = 'keep' THEN new WHEN yes THEN new WHEN old <> '' THEN old ELSE new END AS line FROM b)
SELECT conv_id, md5(coalesce(string_agg(line, chr(10) ORDER BY turn), '')) AS description FROM l GROUP BY conv_id""")
def diff_projection(spark, sf_dir):
    """A conversation as one role, its turns as lines; decisions are there for all, declined for the first two."""
    action = F.when(F.col("role") == "user", "modify").when(F.col("turn") == 1, "remove").otherwise("keep")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct(F.coalesce("text", F.lit("")).alias("old"), F.concat(F.lit("new "), F.col("turn").cast("string")).alias("new"), action.alias("action")).alias("b"))
    diff = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "b"))), lambda x: x["b"]).alias("bullets")).select(F.col("conv_id").alias("resume_id"), F.lit(0).alias("index"), "bullets")
    said = turns.select(F.col("conv_id").alias("resume_id"), F.lit(0).alias("index"), F.col("turn").cast("int").alias("bullet"), (F.col("turn") >= 2).alias("accepted"))
    return tailoring.projected(diff, said).select(F.col("resume_id").alias("conv_id"), F.md5("description").alias("description"))


@query("""SELECT DISTINCT user_id, event_type, ts::DATE AS day FROM events""")
def stream_view_dedupe(spark, sf_dir):
    """The keys that the stream lets through, one for each user, type and day."""
    events = read(spark, sf_dir, "events")
    source = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    return _drained(spark, stream.deduped(source, ("user_id", "event_type")).select("user_id", "event_type", "day"), "append")


def _drained(spark, frame, mode):
    """What a stream returns for all that is there now."""
    path = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    frame.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(frame.schema).parquet(path)


@query("""WITH e AS (SELECT ts, event_type, CASE WHEN event_id % 11 = 0 THEN ts + INTERVAL 4 DAY ELSE ts END AS arrived FROM events),
b AS (SELECT *, date_diff('day', (SELECT min(arrived) FROM e)::DATE, arrived::DATE) // 6 AS step FROM e),
w AS (SELECT step, max(max(ts)) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 DAY AS mark FROM b GROUP BY step),
c AS (SELECT ts::DATE AS day, event_type, coalesce(date_trunc('day', ts) + INTERVAL 1 DAY <= mark, FALSE) AS late FROM b JOIN w USING (step))
SELECT day, count(*) FILTER (NOT late AND event_type = 'view') AS views, count(*) FILTER (NOT late AND event_type = 'click') AS clicks, count(*) FILTER (NOT late) AS events, count(*) FILTER (late) AS late
FROM c WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events) GROUP BY day HAVING count(*) FILTER (NOT late) > 0""")
def stream_daily_counts(spark, sf_dir):
    """Finished days of events that arrive in steps of six days, one in eleven of them four days after it happened.

    Each step is taken in by a stream that starts anew from its state; a day is finished two days after its end. late: events of
    the day that came after that.
    """
    events = read(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    arrived = F.when(F.col("event_id") % 11 == 0, F.col("ts") + F.expr("interval 4 days")).otherwise(F.col("ts"))
    first, last = events.agg(F.min(F.to_date(arrived)), F.max(F.to_date(arrived))).first()
    root = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    events.limit(0).write.parquet(f"{root}-in")  # a stream's folder has to be there
    counts = stream.daily(spark.readStream.schema(events.schema).parquet(f"{root}-in"), {"views": "event_type = 'view'", "clicks": "event_type = 'click'", "events": "true"}, late="2 days")
    for step in range((last - first).days // 6 + 1 if first else 0):
        events.where(F.floor(F.date_diff(arrived, F.lit(first)) / 6) == step).write.mode("append").parquet(f"{root}-in")
        stream.take_in(counts, root, f"{root}-state")
    found = spark.read.schema(counts.schema).parquet(root) if first else spark.createDataFrame([], counts.schema)
    happened = events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("happened"))
    return found.join(happened, "day").select("day", "views", "clicks", "events", (F.col("happened") - F.col("events")).alias("late"))


@query(None)
def headings(spark, sf_dir):
    """Lines that read like a section's heading, with the section."""
    found = lines.text_lines(docs(spark, sf_dir)).where(F.char_length("text") <= 60)
    return found.select("doc_id", "line_no", sections.section_key(F.col("text")).alias("section")).where("section is not null")


@query(None)
def cleaned_lines(spark, sf_dir):
    """Number of lines of each document after the folds."""
    return cleaning.fold_lines(lines.text_lines(docs(spark, sf_dir)).withColumn("heading", F.lit(False))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query(None)
def host_capabilities(spark, sf_dir):
    return files.capabilities(spark)


@query(None)
def parsed_records(spark, sf_dir):
    """Every conversation's turns as one pasted text, to a record."""
    said = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    found = records.parse_texts(said)
    return found.select("doc_id", "contact_information.name", "contact_information.email", F.size("work_experience").alias("n_roles"), F.size("education").alias("n_degrees"), "confidence.overall")
