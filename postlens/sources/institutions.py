"""The institution dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "id long, name string, institution_type string, region string, official_url string, listing_url string, crawl_strategy string, enabled boolean"


def load_institutions(rows: DataFrame) -> DataFrame:
    """The declared columns of landed rows, in order of id; flags of 0 and 1 become booleans."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return rows.select(*[F.col(n).cast("boolean").alias(n) if n == "enabled" else n for n in names]).orderBy("id")


def with_blocked_reason(institutions: DataFrame, reasons: DataFrame, default: str) -> DataFrame:
    """Adds blocked_reason: null if enabled, else the reason on record (id, reason) or the default."""
    return institutions.join(reasons, "id", "left").withColumn("blocked_reason", F.when(~F.col("enabled"), F.coalesce("reason", F.lit(default)))).drop("reason")
