"""Dates and intervals of profile entries: parsing, overlaps, checks of profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERLAP, PER_STRETCH = 0.5, 64
#: What stands for an open end.
OPEN_ENDED = ("至今", "now", "present", "current")
#: Level names and the words that mean them.
LEVELS = ("beginner", "intermediate", "advanced", "expert")
LEVEL_ALIASES = {
    "入门": "beginner", "了解": "beginner", "初级": "beginner", "一般": "intermediate", "中级": "intermediate", "掌握": "intermediate", "熟悉": "intermediate", "熟练": "advanced", "高级": "advanced", "精通": "expert", "专家": "expert",
}


def is_open(raw: Column) -> Column:
    return F.lower(F.trim(raw)).isin(*OPEN_ENDED)


def date_parse(raw: Column, as_of: str) -> Column:
    """YYYY, YYYY-M or YYYY-M-D as its first day, an open end as as_of, all else null."""
    text = F.trim(raw)
    part = lambda i: F.regexp_extract(text, r"^(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?$", i)
    padded = F.concat_ws("-", part(1), F.when(part(2) == "", "01").otherwise(F.lpad(part(2), 2, "0")), F.when(part(3) == "", "01").otherwise(F.lpad(part(3), 2, "0")))
    return F.when(is_open(raw), F.lit(as_of).cast("date")).when(text.rlike(r"^\d{4}(-\d{1,2}){0,2}$") & ~text.startswith("0000"), F.try_to_date(padded, "yyyy-MM-dd"))


def interval_build(rows: DataFrame, as_of: str) -> DataFrame:
    """rows (start_raw, end_raw) with start and end; without a start there is none, without an end it is a point."""
    start, end = date_parse(F.col("start_raw"), as_of), date_parse(F.col("end_raw"), as_of)
    return rows.withColumn("start", start).withColumn("end", F.when(F.col("start").isNotNull(), F.coalesce(end, F.col("start"))))


def overlap_ratio(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Intersection by the shorter interval; a point only overlaps an interval that starts with it, wholly."""
    a_stop, b_stop = F.greatest(a_end, a_start), F.greatest(b_end, b_start)
    shorter = F.least(F.datediff(a_stop, a_start), F.datediff(b_stop, b_start))
    shared = F.datediff(F.least(a_stop, b_stop), F.greatest(a_start, b_start))
    return F.when(shared < 0, 0.0).when(shorter == 0, F.when((shared == 0) & (a_start == b_start), 1.0).otherwise(0.0)).otherwise(shared / shorter)


def _grid(intervals: DataFrame) -> DataFrame:
    """user_id, collection, low (first start), width (days) and last: stretches of a user's time in which some PER_STRETCH entries start."""
    days = F.datediff(F.max("start"), F.min("start")) + 1
    many = F.greatest(F.ceil(F.count(F.lit(1)) / PER_STRETCH), F.lit(1))
    width = F.greatest(F.ceil(days / many), F.lit(1)).cast("int")
    return intervals.groupBy("user_id", "collection").agg(F.min("start").alias("low"), width.alias("width"), F.floor((days - 1) / width).cast("int").alias("last"))


def _touching(earlier: DataFrame, later: DataFrame, before: Column) -> DataFrame:
    """Pairs of rows with grid (aliases a and b) of which b starts while a is open; before: what else orders them.

    Each entry of `later` stands in the stretch in which it starts, each of `earlier` is carried on through those in
    which it is open. So a pair is met once, and a busy user's time is worked on by many tasks.
    """
    at = lambda day: F.least(F.greatest(F.floor(F.datediff(day, F.col("low")) / F.col("width")).cast("int"), F.lit(0)), F.col("last"))
    a = earlier.withColumn("stretch", F.explode(F.sequence(at(F.col("start")), at(F.col("stop"))))).alias("a")
    b = later.withColumn("stretch", at(F.col("start"))).alias("b")
    same = (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.collection") == F.col("b.collection")) & (F.col("a.stretch") == F.col("b.stretch"))
    return a.join(b, same & before & (F.col("a.stop") >= F.col("b.start")))


def _overlapping(pairs: DataFrame, left: Column, right: Column) -> DataFrame:
    ratio = overlap_ratio(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end"))
    return pairs.select("a.user_id", "a.collection", left.alias("left_id"), right.alias("right_id"), ratio.alias("ratio")).filter(F.col("ratio") >= OVERLAP)


def _known(intervals: DataFrame, grid: DataFrame) -> DataFrame:
    known = intervals.filter("start is not null").select("user_id", "collection", "item_id", "start", "end", F.greatest("end", "start").alias("stop"))
    return known.join(grid, ["user_id", "collection"])


def overlap_pairs(intervals: DataFrame) -> DataFrame:
    """intervals: user_id, collection, item_id, start, end. Pairs of a user's entries that overlap by half or more."""
    known = _known(intervals, _grid(intervals.filter("start is not null")))
    order = (F.col("a.start") < F.col("b.start")) | ((F.col("a.start") == F.col("b.start")) & (F.col("a.item_id") < F.col("b.item_id")))
    return _overlapping(_touching(known, known, order), F.least("a.item_id", "b.item_id"), F.greatest("a.item_id", "b.item_id"))


def overlap_flagged(pairs: DataFrame) -> DataFrame:
    both = pairs.select("user_id", F.col("left_id").alias("item_id")).unionByName(pairs.select("user_id", F.col("right_id").alias("item_id")))
    return both.distinct()


def overlap_new_item(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (left_id) with the entries (right_id) of their user and collection that they overlap by half or more."""
    grid = _grid(existing.filter("start is not null"))
    old, new = _known(existing, grid), _known(candidates, grid)
    other = F.col("a.item_id") != F.col("b.item_id")
    after = _touching(old, new, other & (F.col("a.start") <= F.col("b.start")))
    before = _touching(new, old, other & (F.col("a.start") < F.col("b.start")))
    return _overlapping(after, F.col("b.item_id"), F.col("a.item_id")).unionByName(_overlapping(before, F.col("a.item_id"), F.col("b.item_id")))


def latest_entries(intervals: DataFrame) -> DataFrame:
    """The entry of the greatest item_id of each user and collection, as if it had just been added."""
    newest = intervals.groupBy("user_id", "collection").agg(F.max("item_id").alias("item_id"))
    return intervals.join(newest, ["user_id", "collection", "item_id"], "left_semi")


def is_blank(item: Column, fields: list[str]) -> Column:
    """Nothing but an id."""
    return reduce(lambda a, b: a & b, [F.trim(F.coalesce(item[f].cast("string"), F.lit(""))) == "" for f in fields])


def _said(fields: list[str]):
    return lambda item: ~is_blank(item, fields)


def profile_nonblank(profiles: DataFrame, collections: dict[str, list[str]]) -> DataFrame:
    """profiles (arrays of structs by collection) with n_nonblank and is_empty."""
    n = reduce(lambda a, b: a + b, [F.greatest(F.size(F.filter(c, _said(fields))), F.lit(0)) for c, fields in collections.items()])
    return profiles.withColumn("n_nonblank", n.cast("long")).withColumn("is_empty", F.col("n_nonblank") == 0)


def profile_fact_count(collections: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.greatest(F.size(c), F.lit(0)) for c in collections]).cast("long")


def skill_level_map(raw: Column, aliases: dict[str, str] = LEVEL_ALIASES, levels: tuple[str, ...] = LEVELS) -> Column:
    """Level names in any case, aliases by a map, else null."""
    text = F.lower(F.trim(raw))
    named = F.when(text.isin(*levels), text)
    return F.coalesce(named, F.try_element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), F.trim(raw))) if aliases else named
