"""Posting queries: trust classes, filters, lists, lookups, last-write-wins tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIXTURE_PARSERS = ("demo-fixture-v1",)
GENERIC_PARSERS = ("generic-visible-page-v1", "generic-fallback-v1")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Folds A-Z alone; lower() folds all of Unicode."""
    return F.translate(c, _UPPER, _LOWER)


def trust_of(enabled: Column, parser_name: Column) -> Column:
    """disabled before fixture before placeholder before real; an institution that isn't known to be enabled is disabled."""
    return F.when(~F.coalesce(enabled, F.lit(False)), "disabled").when(parser_name.isin(*FIXTURE_PARSERS), "fixture").when(parser_name.isin(*GENERIC_PARSERS), "placeholder").otherwise("real")


def trust_class(jobs: DataFrame, institutions: DataFrame) -> DataFrame:
    """jobs with `trust`."""
    on = institutions.filter("enabled").select(F.col("id").alias("institution_id"), F.lit(True).alias("_on"))
    return jobs.join(on, "institution_id", "left").withColumn("trust", trust_of(F.col("_on"), F.col("parser_name"))).drop("_on")


def filter_trust(jobs: DataFrame, institutions: DataFrame, trust: str) -> DataFrame:
    enabled = institutions.filter("enabled" if trust != "disabled" else "not enabled").select(F.col("id").alias("institution_id"))
    inside = jobs.join(enabled, "institution_id", "left_semi")
    if trust == "disabled":
        return inside
    known = {"fixture": F.col("parser_name").isin(*FIXTURE_PARSERS), "placeholder": F.col("parser_name").isin(*GENERIC_PARSERS)}
    return inside.filter(known[trust]) if trust in known else inside.filter(F.coalesce(~F.col("parser_name").isin(*FIXTURE_PARSERS, *GENERIC_PARSERS), F.lit(True)))


def contains_like(c: Column, keyword: Column | str) -> Column:
    """LIKE %keyword% with the ASCII-only folding of the posting store."""
    word = F.lit(keyword) if isinstance(keyword, str) else keyword
    return F.call_function("like", ascii_lower(c), F.concat(F.lit("%"), ascii_lower(word), F.lit("%")))


def filter_keyword(jobs: DataFrame, keyword: str) -> DataFrame:
    return jobs.filter(reduce(lambda a, b: a | b, [contains_like(F.col(c), keyword) for c in ("title", "raw_text", "institution_name")]))


def filter_equals(jobs: DataFrame, **wanted) -> DataFrame:
    """Falsy values are no filter."""
    return jobs.filter(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in wanted.items() if v], F.lit(True)))


def filter_tag(jobs: DataFrame, tag: str) -> DataFrame:
    return jobs.filter(F.exists("tags", lambda t: contains_like(t, tag)))


def filter_fresh_days(jobs: DataFrame, days: int, as_of: str) -> DataFrame:
    if not 1 <= days <= 3650:
        raise ValueError("days must be from 1 to 3650")
    return jobs.filter(F.col("fetched_at") >= F.timestamp_add("DAY", F.lit(-days), F.lit(as_of).cast("timestamp")))


def jobs_list(jobs: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page, newest first, with the count of all in `total`."""
    page = jobs.orderBy(F.desc("fetched_at"), F.desc("id")).offset(offset).limit(min(limit, 500))
    return page.crossJoin(F.broadcast(jobs.agg(F.count(F.lit(1)).alias("total"))))  # one row


def status_upsert(log: DataFrame) -> DataFrame:
    """Last write a (user, job): created at the first write since the last deletion, the rest from the latest; deleted ones are gone."""
    w = Window.partitionBy("user_id", "job_id").orderBy("seq")
    life = log.withColumn("life", F.sum(F.col("deleted").cast("int")).over(w))
    last = F.max("life").over(Window.partitionBy("user_id", "job_id"))
    live = life.withColumn("last", last).filter("life = last and not deleted")
    return live.groupBy("user_id", "job_id").agg(
        F.max_by("status", "seq").alias("status"), F.max_by("note", "seq").alias("note"), F.min_by("happened", "seq").alias("created_at"), F.max_by("happened", "seq").alias("updated_at")
    )


def job_user_status(jobs: DataFrame, statuses: DataFrame, user_id: int) -> DataFrame:
    own = statuses.filter(F.col("user_id") == user_id).select(F.col("job_id").alias("id"), "status", "note")
    return jobs.join(own, "id", "left")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last by `order`."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"), F.max(order).alias(order)).select(key, "r.*", order)


def freshness_tag(posted_at: Column, fetched_at: Column, as_of: str) -> Column:
    """新 within a day, 今日 within one calendar day, else empty, as for the future."""
    now, at = F.lit(as_of).cast("timestamp"), F.coalesce(posted_at, fetched_at)
    age = F.unix_timestamp(now) - F.unix_timestamp(at)
    return F.when(at.isNull() | (age < 0), "").when(age <= 86_400, "新").when(F.datediff(now, at) <= 1, "今日").otherwise("")
