"""What the operators of this folder share: tables in the shared folder and small column rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}

#: The characters of `[\x20\x09-\x0D]`.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    A local session without that setting gets a temporary folder; a cluster without it is an error,
    as a folder of one machine would be unreadable elsewhere.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = _local.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="postlens-")
        _local[spark.sparkContext.applicationId] = at
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and returns the reread table.

    This cuts the lineage and survives the loss of executors.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many leading underscores as it takes to differ from all columns of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of that very name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def unit_hash(*parts: Column | str) -> Column:
    """A double in [0, 1) from the first 52 bits of the MD5 digest of the parts, joined by ':'."""
    joined = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
