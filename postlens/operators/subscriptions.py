"""Keyword subscriptions: new postings since a checkpoint, warnings, pushes, notifications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.text import grams, txt_keyword_match
from postlens.operators.postings import ascii_lower, contains_like

GRAM = 3
#: Up to so many anchors are looked for in a posting one by one; beyond that its pieces are cut.
FEW = 64
HIT_CAP, SHOWN, BROAD, DEFAULT_SOURCES, DAYS = 100, 3, 0.5, 12, 30


def watched(subs: DataFrame) -> DataFrame:
    """A row a subscription and institution, so that joins have an equal key."""
    return subs.select("*", F.explode("institution_ids").alias("institution_id"))


def sub_maintenance(subs: DataFrame, institutions: DataFrame) -> DataFrame:
    """subscription_id, institution_id, maintenance: not enabled, or failed last time (review is not)."""
    state = institutions.select(F.col("id").alias("institution_id"), (~F.col("enabled") | (F.col("last_status") == "failed")).alias("maintenance"))
    return watched(subs).join(state, "institution_id").select(F.col("id").alias("subscription_id"), "institution_id", "maintenance")


def active(subs: DataFrame, institutions: DataFrame) -> DataFrame:
    """watched() without institutions in maintenance and blank keywords."""
    ok = sub_maintenance(subs, institutions).filter("not maintenance").select(F.col("subscription_id").alias("id"), "institution_id")
    return watched(subs).filter(F.trim("keyword") != "").join(ok, ["id", "institution_id"], "left_semi")


def _part(keyword: Column) -> Column:
    """The longest part of a keyword without wildcards, of several the greatest."""
    parts = F.transform(F.split(ascii_lower(keyword), r"[%_\\\\]"), lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))
    return F.array_max(parts)["p"]


def anchor_size(keyword: Column) -> Column:
    return F.least(F.length(_part(keyword)), F.lit(GRAM))


def keyword_anchors(keywords: DataFrame) -> DataFrame:
    """keyword, gram: a piece of up to GRAM characters that each text with the keyword holds, of its longest part without wildcards.

    Of several the one that the fewest keywords hold. A keyword of wildcards alone has the empty piece.
    """
    part = keywords.select("keyword").distinct().select("keyword", _part(F.col("keyword")).alias("part"), anchor_size(F.col("keyword")).alias("size"))
    pieces = reduce(lambda acc, n: acc.when(F.col("size") == n, grams(F.col("part"), n)), range(GRAM + 1), F)
    each = part.select("keyword", F.explode(pieces).alias("gram"))
    return each.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("gram"))).groupBy("keyword").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))


def keyword_candidates(asked: DataFrame, jobs: DataFrame, sizes: list[int], fields: tuple[str, ...] = ("title", "raw_text", "institution_name")) -> DataFrame:
    """jobs (institution_id, fields, ...) with the rows of asked (institution_id, keyword, ...) whose anchor one of the fields holds; sizes: those of the anchors.

    An index of keywords by institution and piece: a posting looks up its own pieces, so what it costs goes by
    its length and not by the number of keywords, each of which it meets once at most.
    """
    # a character that no text holds keeps pieces within a field
    text = ascii_lower(F.concat_ws("\x00", *fields))
    anchors = keyword_anchors(asked)
    few = [g for (g,) in anchors.select("gram").distinct().limit(FEW + 1).collect()]
    if 0 < len(few) <= FEW:
        pieces = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(g)), F.lit(g)) for g in few]))
    else:
        pieces = F.array_distinct(F.concat(*[grams(text, n) for n in sizes])) if sizes else F.array(F.lit(""))
    posted = asked.join(anchors, "keyword").withColumnRenamed("gram", "_gram")
    return jobs.withColumn("_gram", F.explode(pieces)).join(posted, ["institution_id", "_gram"]).drop("_gram")


def keyword_hits(watching: DataFrame, jobs: DataFrame, since: str | None = None) -> DataFrame:
    """watching joined with the postings that hold its keyword in title, text or institution name, as LIKE does; `whole` says whether as a word.

    A keyword is looked for once an institution, however many subscriptions share it, and with `since` (a
    column of watching) only in postings after the least checkpoint of these. An ASCII keyword must be a word.
    """
    after = F.lit(None).cast("timestamp") if since is None else F.col(since)
    asked = watching.groupBy("institution_id", "keyword").agg(F.min(after).alias("_least"), F.bool_or(after.isNull()).alias("_all"))
    j = jobs.select("institution_id", F.col("id").alias("job_id"), "title", "raw_text", "institution_name", "fetched_at")
    # one row: the least checkpoint and the few sizes of anchors
    first = watching.agg(F.min(after).alias("least"), F.count_if(after.isNull()).alias("open"), F.array_sort(F.collect_set(anchor_size(F.col("keyword")))).alias("sizes")).first()
    if first.least is not None and not first.open:
        j = j.filter(F.col("fetched_at") > F.lit(first.least))  # reaches the scan
    like = contains_like(F.col("title"), F.col("keyword")) | contains_like(F.col("raw_text"), F.col("keyword")) | contains_like(F.col("institution_name"), F.col("keyword"))
    met = keyword_candidates(asked, j, first.sizes).filter((F.col("_all") | (F.col("fetched_at") > F.col("_least"))) & F.coalesce(like, F.lit(False)))
    text = F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("title", "institution_name", "raw_text")])
    whole = ~F.trim("keyword").rlike(r"^[\x00-\x7F]*$") | txt_keyword_match(text, F.col("keyword"))
    hits = met.select("institution_id", "keyword", "job_id", "title", "fetched_at", whole.alias("whole"))
    out = watching.join(hits, ["institution_id", "keyword"])
    return out if since is None else out.filter(F.col(since).isNull() | (F.col("fetched_at") > F.col(since)))


def newest(hits: DataFrame, cap: int = HIT_CAP) -> DataFrame:
    """The newest `cap` LIKE hits of a subscription first, then whole words among them."""
    w = Window.partitionBy("id").orderBy(F.desc("fetched_at"), F.desc("job_id"))
    return hits.withColumn("place", F.row_number().over(w)).filter((F.col("place") <= cap) & F.col("whole"))


def sub_new_jobs(watching: DataFrame, jobs: DataFrame, since: str = "last_checked_at", cap: int = HIT_CAP) -> DataFrame:
    """Hits fetched after the checkpoint, the newest ones."""
    return newest(keyword_hits(watching, jobs, since), cap)


def sub_new_count(subs: DataFrame, new: DataFrame) -> DataFrame:
    n = new.groupBy("id").agg(F.count(F.lit(1)).alias("n_new"))
    return subs.select("id").join(n, "id", "left").fillna(0, ["n_new"])


def sub_empty_30d(subs: DataFrame, watching: DataFrame, jobs: DataFrame, as_of: str, days: int = DAYS) -> DataFrame:
    """Subscriptions without a whole-word match in the last days."""
    since = F.timestamp_add("DAY", F.lit(-days), F.lit(as_of).cast("timestamp"))
    some = keyword_hits(watching, jobs.filter(F.col("fetched_at") >= since)).filter("whole").select("id")
    return subs.join(some, "id", "left_anti")


def sub_broad_keyword(watching: DataFrame, jobs: DataFrame) -> DataFrame:
    """id, matched, total, percent of subscriptions whose keyword matches over half of their institutions' postings."""
    totals = watching.join(jobs.groupBy("institution_id").agg(F.count(F.lit(1)).alias("n")), "institution_id").groupBy("id").agg(F.sum("n").alias("total"))
    matched = keyword_hits(watching, jobs).filter("whole").groupBy("id").agg(F.count(F.lit(1)).alias("matched"))
    ratio = F.col("matched") / F.col("total")
    return totals.join(matched, "id").filter(ratio > BROAD).select("id", "matched", "total", (ratio * 100).cast("int").cast("long").alias("percent"))


def due(watching: DataFrame) -> DataFrame:
    """watching with since: the last push, else the last visit."""
    return watching.withColumn("since", F.coalesce("last_pushed_at", "last_checked_at"))


def notifications(new: DataFrame) -> DataFrame:
    """A row a subscription with new hits: subscription_id, since, job_count, job_ids, summary, newest_at."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.unix_timestamp("fetched_at")).alias("t"), (-F.col("job_id")).alias("j"), "title")))
    each = new.groupBy(F.col("id").alias("subscription_id"), "user_id", "keyword", "since").agg(ordered.alias("hits"), F.max("fetched_at").alias("newest_at"))  # at most the cap
    titles = F.array_join(F.transform(F.slice("hits", 1, SHOWN), lambda h: h["title"]), "、")
    n = F.size("hits")
    return each.select(
        "subscription_id", "user_id", "keyword", "since", n.cast("long").alias("job_count"), F.transform("hits", lambda h: -h["j"]).alias("job_ids"),
        F.when(n > SHOWN, F.concat(titles, F.format_string(" 等 %d 条", n))).otherwise(titles).alias("summary"), "newest_at",
    )


def sub_scan(watching: DataFrame, jobs: DataFrame) -> DataFrame:
    """The notifications of a scan: the checkpoint is the last push, else the last visit; (subscription_id, since) identifies the row."""
    return notifications(sub_new_jobs(due(watching), jobs, "since"))


def sub_list(subs: DataFrame) -> DataFrame:
    return subs.filter("not deleted").orderBy("user_id", F.desc("created_at"), F.desc("id"))


def sub_mark_read(subs: DataFrame, visits: DataFrame) -> DataFrame:
    """visits: id, at. The last visit moves last_checked_at; the push time stays."""
    last = visits.groupBy("id").agg(F.max("at").alias("_at"))
    return subs.join(last, "id", "left").withColumn("last_checked_at", F.coalesce("_at", "last_checked_at")).drop("_at")


def sub_defaults(requests: DataFrame, institutions: DataFrame, most: int = DEFAULT_SOURCES) -> DataFrame:
    """requests: id, institution_ids (null: the first enabled ones). Adds ids, unknown (count of ids that don't exist) and valid."""
    first = institutions.filter("enabled").orderBy("id").limit(most).agg(F.array_sort(F.collect_list("id")).alias("_first"))
    out = requests.crossJoin(F.broadcast(first)).withColumn("ids", F.coalesce("institution_ids", "_first")).drop("_first")  # one row
    bad = out.select("id", F.explode("ids").alias("institution_id")).join(institutions.select(F.col("id").alias("institution_id")), "institution_id", "left_anti")
    out = out.join(bad.groupBy("id").agg(F.count(F.lit(1)).alias("unknown")), "id", "left").fillna(0, ["unknown"])
    return out.withColumn("valid", (F.col("unknown") == 0) & F.size("ids").between(1, most))


def notif_list(notifications: DataFrame, newest: int = 20) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    return notifications.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= newest)


def notif_unread(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("user_id").agg(F.count_if(F.col("read_at").isNull()).alias("unread"))


def notif_mark_read(notifications: DataFrame, reads: DataFrame) -> DataFrame:
    """reads: user_id, id (null: all of the user's up to then), at. The first read counts and stays."""
    n = notifications.alias("n")
    one = n.join(reads.filter("id is not null").alias("r"), ["user_id", "id"]).select("user_id", "id", "r.at")
    every = n.join(reads.filter("id is null").select("user_id", "at"), "user_id").filter("at >= created_at").select("user_id", "id", "at")
    first = one.unionByName(every).groupBy("user_id", "id").agg(F.min("at").alias("_at"))
    return notifications.join(first, ["user_id", "id"], "left").withColumn("read_at", F.coalesce("read_at", "_at")).drop("_at")
