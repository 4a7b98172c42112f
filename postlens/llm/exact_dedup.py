"""Exact deduplication: 128-bit content hash, then a comparison of bytes inside the groups.

Texts are equal when they are the same after ASCII white space is deleted. A null text counts as empty,
so all null, empty and blank texts form one group. Rows that repeat an id and a text are told apart by
a running number, and only one of them is kept.

The bytes of a group are all equal if its least and its greatest text are. Both come from partial minima
and maxima in each task, so a group of any size sends a row a task, never its members, to one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, quoted, text_or_empty, unused, written

#: Up to so many hashes (8 bytes each) of groups are broadcast; beyond it they are joined in a shuffle.
BROADCAST_HASHES = 1_000_000


def _normal() -> Column:
    return F.translate(text_or_empty(), ASCII_SPACE, "")


def _rank():
    return F.struct((-F.col("chars")).alias("minus"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"))


def _collided(docs: DataFrame, groups: DataFrame, digest) -> DataFrame:
    """text_md5 of the groups whose texts differ in a byte."""
    # texts of two hashes differ; where a group has one hash, its texts are asked for by it
    apart = groups.filter("short <> other").select("text_md5")
    several = written(groups.filter("group_size > 1 and short = other").select("short").distinct(), "dedup-several")
    few = F.broadcast(several) if several.count() <= BROADCAST_HASHES else several
    texts = docs.select(_normal().alias("norm")).withColumn("short", F.xxhash64("norm")).join(few, "short", "left_semi")
    bounds = texts.groupBy(digest("norm").alias("text_md5")).agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    return written(bounds.filter("low <> high").select("text_md5").unionByName(apart).distinct(), "dedup-collisions")


def dedup(docs: DataFrame, digest=F.md5) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, text_md5.

    Of equal texts the row with the most code points stays, then the smallest doc_id. Other columns of docs
    are not read. digest: the content hash; a shorter one costs time, not correctness.
    """
    wide = docs.select("doc_id", F.length(text_or_empty()).cast("long").alias("chars"), _normal().alias("norm"))
    slim = wide.select("doc_id", "chars", digest("norm").alias("text_md5"), F.sha2("norm", 256).alias("text_sha256"), F.xxhash64("norm").alias("short"))
    # repeated rows collapse before the shuffle, so a row that repeats without end stays one row here
    slim = written(slim.groupBy("text_md5", "text_sha256", "doc_id", "chars").agg(F.count(F.lit(1)).alias("times"), F.min("short").alias("short"), F.max("short").alias("other")), "dedup-hashes")
    groups = slim.groupBy("text_md5").agg(F.sum("times").alias("group_size"), F.min(_rank()).alias("best"), F.min("short").alias("short"), F.max("other").alias("other"))
    groups = written(groups.select("text_md5", "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.minus")).alias("keep_chars"), "short", "other"), "dedup-groups")
    collided = _collided(docs, groups, digest)

    found, members = groups.drop("short", "other"), slim.drop("short", "other")
    rows = members.join(found, "text_md5")
    if not collided.isEmpty():
        # groups in which a byte differs are split by the bytes themselves
        exact = (
            wide.withColumn("text_md5", digest("norm"))
            .join(collided, "text_md5")
            .groupBy("text_md5", "norm")
            .agg(F.count(F.lit(1)).alias("group_size"), F.min(_rank()).alias("best"))
            .select("text_md5", F.sha2("norm", 256).alias("text_sha256"), "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.minus")).alias("keep_chars"))
        )
        rows = rows.join(collided, "text_md5", "left_anti").unionByName(members.join(exact, ["text_md5", "text_sha256"]))
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars")) & (F.col("time") == 1)
    return rows.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc_id", "keep_id", "group_size", first.alias("kept"), "text_sha256", "text_md5")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names.

    Of rows that repeat a kept id and its text one stays: the longest, then the one of the least text, then
    the one of the least hash of its other columns (maps aside), then any, as they are the same.
    """
    name, digest, rank = unused(docs, "_name", "_digest", "_rank")
    kept = dedup(docs).filter("kept").select(F.col("doc_id").alias(name), F.col("text_sha256").alias(digest))
    marked = docs.withColumns({name: F.col("doc_id"), digest: F.sha2(_normal(), 256)})
    rows = marked.join(kept, marked[name].eqNullSafe(kept[name]) & (marked[digest] == kept[digest]), "left_semi")
    columns = [quoted(c) for c in docs.columns]
    several = written(rows.groupBy(name, digest).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(name, digest), "dedup-repeats")
    if several.isEmpty():
        return rows.select(*columns)
    same = rows[name].eqNullSafe(several[name]) & (rows[digest] == several[digest])
    hashed = [quoted(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and not isinstance(f.dataType, T.VariantType)]
    best = F.struct((-F.length(text_or_empty())).alias("a"), text_or_empty().alias("b"), F.xxhash64(*hashed).alias("c"))
    # partial minima: a row that repeats without end is one row a task
    one = rows.join(several, same, "left_semi").withColumn(rank, best).groupBy(name, digest).agg(F.min_by(F.struct(*columns), F.col(rank)).alias(rank))
    return rows.join(several, same, "left_anti").select(*columns).unionByName(one.select(f"{rank}.*"))
