"""Tables to and from a shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; a local session without it gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="postlens-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes Parquet and returns the reread table, with the schema that was written."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert_table(new: DataFrame, path: str, keys: list[str], order: list[str], buckets: int = 64) -> DataFrame:
    """Merges rows into the table at path, of which the row of the greatest order stays for each key; returns the table.

    The table is partitioned by a hash of the keys. Only partitions that a new row falls into are read, merged and
    overwritten, so a small merge rewrites a small part. A merge that runs again gives the same table.
    """
    spark = new.sparkSession
    placed = new.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    merged = placed
    if home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(home):
        touched = [b for (b,) in placed.select("_bucket").distinct().collect()]  # at most `buckets`
        merged = spark.read.schema(placed.schema).parquet(path).filter(F.col("_bucket").isin(touched)).unionByName(placed)
    columns = [c for c in new.columns if c not in keys]
    latest = merged.groupBy("_bucket", *keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("row")).select(*keys, "row.*", "_bucket")
    # written aside first, as a table can't be overwritten while it is read
    aside = write_table(latest, f"{path}-merge-{uuid.uuid4().hex}")
    aside.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
    return spark.read.schema(placed.schema).parquet(path).drop("_bucket")
