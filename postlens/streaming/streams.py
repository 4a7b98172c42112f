"""Continuous forms of the ingest and subscription jobs.

Each micro-batch writes what it adds, and nothing else, to folders of its number, so its work grows with the
batch and not with what came before. A batch that runs again after a failure overwrites its own folders with
the same rows. Crawls retry and arrive late, so nothing depends on the order of batches: what is stored can be
put together in any order, and a row that arrives twice counts once.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postlens.operators import ingest, subscriptions


def _append(stream: DataFrame, target: str, checkpoint: str, steps: dict[str, Callable[[DataFrame], DataFrame]]) -> StreamingQuery:
    """Writes steps[table](batch) of each micro-batch to target/table/batch=<number>; empty folders -1 give the tables their columns."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        for table, step in steps.items():
            step(batch).write.mode("overwrite").parquet(f"{target}/{table}/batch={number}")

    write(spark.createDataFrame([], stream.schema), -1)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, target: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{target}/{table}").drop("batch")


#: A posting's text is stored once, under its digest.
_SLIM = (*ingest.KEY, "seq", "source_text_hash", "parser_name", *ingest.DIMENSIONS, "fetched_at", "text_digest")


def stream_posting_upsert(observations: DataFrame, checkpoint: str, target: str) -> StreamingQuery:
    """Tables `seen` (an observation without its text) and `texts` (a text a digest). Read with `current` or `snapshots`.

    A run of equal observations can't be kept as its two ends: a late row may part it anywhere, and then each
    of them may begin or end a version. What is stored a row is its identity, times and digest.
    """
    digest = lambda batch: batch.withColumn("text_digest", F.sha2(F.coalesce("raw_text", F.lit("\x00")), 256))
    steps = {
        "seen": lambda batch: digest(batch).select(*_SLIM),
        "texts": lambda batch: digest(batch).select("text_digest", "raw_text").distinct(),
    }
    return _append(observations, target, checkpoint, steps)


def _seen(spark: SparkSession, target: str) -> DataFrame:
    """Each observation once, its digest in place of its text."""
    # dealt out by identity, which serves the versions behind too
    return stored(spark, target, "seen").repartition(*ingest.KEY).dropDuplicates([*ingest.KEY, "seq"]).withColumnRenamed("text_digest", "raw_text")


def _with_texts(versions: DataFrame, spark: SparkSession, target: str) -> DataFrame:
    texts = stored(spark, target, "texts").distinct().withColumnRenamed("raw_text", "_text")
    return versions.join(texts, versions["raw_text"] == texts["text_digest"]).withColumn("raw_text", F.col("_text")).select(versions.columns)


def current(spark: SparkSession, target: str) -> DataFrame:
    return _with_texts(ingest.posting_current(_seen(spark, target)), spark, target)


def snapshots(spark: SparkSession, target: str) -> DataFrame:
    return _with_texts(ingest.posting_snapshots(_seen(spark, target)), spark, target)


def stream_source_health(outcomes: DataFrame, checkpoint: str, target: str) -> StreamingQuery:
    """Table `outcomes`: of each batch and institution its last success and the failures behind it. Read with `health`.

    Rows before a success can't count any more, whatever arrives later; so what batches keep may be joined in any
    order and cut again in the same way.
    """
    return _append(outcomes, target, checkpoint, {"outcomes": lambda batch: ingest.trailing(batch.select("institution_id", "seq", "ok").distinct())})


def health(spark: SparkSession, target: str) -> DataFrame:
    """institution_id, consecutive_failures, last_seq, status."""
    return ingest.source_health(stored(spark, target, "outcomes").distinct())


def stream_sub_scan(jobs: DataFrame, watching: DataFrame, checkpoint: str, target: str, late: str = "90 days") -> StreamingQuery:
    """Table `notifications`: of each batch of postings, a row a subscription with hits after its checkpoint.

    A posting is pushed to a subscription once, however often and in whatever order it arrives, as long as it is
    no more than `late` behind the newest one; the state holds the pushes of that time alone.
    """
    due = subscriptions.due(watching)
    hits = subscriptions.keyword_hits(due, jobs.withWatermark("fetched_at", late), "since").dropDuplicatesWithinWatermark(["id", "job_id"])
    return _append(hits, target, checkpoint, {"notifications": lambda batch: subscriptions.notifications(subscriptions.newest(batch))})


#: A distributed store renames in one step; a local one looks first and moves then, so scans of one process take turns.
_publishing = threading.Lock()


def _publish(spark: SparkSession, staged: str, to: str) -> bool:
    """Moves a folder to a name that must not exist; False if it does."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(staged).toUri(), conf) if path(staged).toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf)
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        with _publishing:
            files.rename(path(staged), path(to), none)
    except Exception as e:
        if "FileAlreadyExistsException" not in str(e):
            raise
        files.delete(path(staged), True)
        return False
    return True


def scan_and_push(watching: DataFrame, jobs: DataFrame, target: str) -> int:
    """One scan of all subscriptions: its notifications go to target/scan=<number>; returns that number.

    Scans may overlap, as when a crawl ends while a user asks for one. Each reads the scans before it, prepares
    its rows aside and claims the next number by a rename that fails if the number is taken. Who loses starts
    again from the winner's scan, so a posting is pushed once. A subscription's checkpoint is the end of the
    last scan that pushed to it.
    """
    spark = jobs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    while True:
        taken = [int(s.getPath().getName()[5:]) for s in files.listStatus(path) if s.getPath().getName().startswith("scan=")]
        number = max(taken, default=-1) + 1
        subs = watching
        if taken:
            before = spark.read.parquet(*[f"{target}/scan={n}" for n in taken]).groupBy(F.col("subscription_id").alias("id")).agg(F.max("pushed_through").alias("through"))
            subs = watching.join(before, "id", "left").withColumn("last_pushed_at", F.greatest("through", "last_pushed_at")).drop("through")
        through = jobs.agg(F.max("fetched_at").alias("pushed_through"))
        staged = f"{target}/_staged-{uuid.uuid4().hex}"
        subscriptions.sub_scan(subs, jobs).crossJoin(F.broadcast(through)).write.parquet(staged)  # one row
        if _publish(spark, staged, f"{target}/scan={number}"):
            return number
