"""Application tracker: lists, counts, totals, dense trends and de-duplicated view events, for all users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The statuses that are always counted.
STATUSES = ("Applied", "Interviewing", "Offer", "Rejected", "Archived")


def js_round(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def job_list(jobs: DataFrame, q: str | None = None, search: tuple[str, ...] = (), status: str | None = None, status_col: str = "status", date_col: str = "applied_on", start: str | None = None, end: str | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a status (all for None or 'All'), whose search columns hold q as literal text, between both days included."""
    out = jobs
    if status and status != "All":
        out = out.where(F.col(status_col) == status)
    if q:
        hit = F.lit(False)
        for c in search:
            hit |= F.contains(F.lower(F.col(c)), F.lit(q.lower()))
        out = out.where(hit)
    if start:
        out = out.where(F.col(date_col) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        out = out.where(F.col(date_col) < F.lit(end).cast("timestamp_ntz") + F.expr("interval 1 day"))
    return out.orderBy(F.col(date_col).desc(), *order)


def status_counts(jobs: DataFrame, user: str = "user", status: str = "status", favourite: Column | None = None, domain: tuple[str, ...] = STATUSES) -> DataFrame:
    """A row for each user: a column for each status of the domain, zero where there is none; `other`, favourites, total."""
    counts = [F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in domain]
    other = F.count_if(~F.coalesce(F.col(status).isin(*domain), F.lit(False))).alias("n_other")
    liked = F.count_if(favourite if favourite is not None else F.lit(False)).alias("favourites")
    return jobs.groupBy(user).agg(*counts, other, liked, F.count(F.lit(1)).alias("total"))


def totals(rows: DataFrame, now: Column, user: str = "user", at: str = "at") -> DataFrame:
    """total, monthly (since the month began) and last7 (168 hours) of each user."""
    return rows.groupBy(user).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(at) >= F.date_trunc("month", now)).alias("monthly"),
        F.count_if(F.col(at) >= now - F.expr("interval 168 hours")).alias("last7"),
    )


def dense_trend(events: DataFrame, at: str, series: dict[str, Column], days: int = 30, by: tuple[str, ...] = (), last: DataFrame | None = None) -> DataFrame:
    """Counts of each series by day over the `days` days up to the last one, zero where there is nothing.

    last: one row with last_day; by default the events' own last day. by: columns with a calendar each.
    """
    daily = events.groupBy(*by, F.to_date(at).alias("day")).agg(*(F.count_if(c).alias(k) for k, c in series.items()))
    last = last if last is not None else daily.agg(F.max("day").alias("last_day"))
    span = last.where("last_day is not null").select(F.explode(F.sequence(F.date_sub("last_day", days - 1), F.col("last_day"))).alias("day"))
    if by:  # the calendar has `days` rows
        span = daily.select(*by).distinct().join(F.broadcast(span))
    return span.join(daily, [*by, "day"], "left").select(*by, "day", *(F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in series))


def first_per_day(views: DataFrame, keys: tuple[str, ...], at: str, tie: tuple[str, ...] = (), url: str | None = None) -> DataFrame:
    """The first event of each key and day; rows with an empty or null url are all kept."""
    order = Window.partitionBy(*keys, F.to_date(at)).orderBy(at, *tie)
    ranked = views.withColumn("_n", F.row_number().over(order))
    keep = F.col("_n") == 1
    if url:
        keep |= F.coalesce(F.col(url), F.lit("")) == ""
    return ranked.where(keep).drop("_n")


def recent(rows: DataFrame, by: str, at: str, k: int = 5, tie: tuple[Column, ...] = ()) -> DataFrame:
    """The k latest rows of each user with their rank."""
    order = Window.partitionBy(by).orderBy(F.col(at).desc(), *tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_default(resumes: DataFrame, user: str, at: str, tie: tuple[str, ...] = ()) -> DataFrame:
    """is_default: a user's first record is the default one."""
    first = Window.partitionBy(user).orderBy(at, *tie)
    return resumes.withColumn("is_default", F.row_number().over(first) == 1)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys."""
    return old.join(new.select(keys), keys, "left_anti").unionByName(new.select(old.columns))


def make_default(resumes: DataFrame, user: str, key: str, chosen: DataFrame) -> DataFrame:
    """At most one default for each user: the one in chosen (user, key), where the user has one there."""
    picked = chosen.select(user, F.col(key).alias("_chosen"))
    return resumes.join(picked, user, "left").withColumn("is_default", F.when(F.col("_chosen").isNull(), F.col("is_default")).otherwise(F.col(key) == F.col("_chosen"))).drop("_chosen")


def mark_applied(postings: DataFrame, user: Column, now: Column, source: str = "Extension") -> DataFrame:
    """Postings as job rows of the tracker."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    company = F.when(text("company") == "", "Unknown").otherwise(text("company"))
    return postings.select(
        user.alias("user"), text("title").alias("title"), company.alias("company"), text("location").alias("location"), text("salary").alias("salary"),
        F.lit("Applied").alias("status"), F.lit(False).alias("favorite"), F.lit(source).alias("source"), text("url").alias("job_url"),
        F.lit("").alias("notes"), F.coalesce("skills_found", F.array().cast("array<string>")).alias("skills"), now.alias("applied_on"),
    )


def time_ago(at: Column, now: Column) -> Column:
    """How long ago, in the largest whole unit."""
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))
    minutes, hours, days = F.floor(seconds / 60), F.floor(seconds / 3600), F.floor(seconds / 86400)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(minutes < 1, "just now").when(minutes < 60, ago(minutes, "m ago")).when(hours < 24, ago(hours, "h ago")).when(days < 30, ago(days, "d ago")).otherwise(F.date_format(at, "yyyy-MM-dd"))
