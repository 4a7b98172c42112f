"""Mixing sources to target weights by Poisson replication.

A document of source s is repeated as often as a Poisson variable with mean rate(s) says. The variable
is the inverse of the distribution at a number that a hash of seed and document fixes, so a rerun of a
task gives the same copies. rate(s) = weight(s) * total / size(s): the expected size stays the total,
and each source's expected share is its weight. Sizes are UTF-8 bytes or rows. A rate above `PART_RATE` is
the sum of independent draws of equal rates, as the sum of Poisson variables is one of the summed rate.

Null sources are a source of their own. Sources without a weight share what is left of 1, or the mean
weight if nothing is left. Sources of no size have rate 0. Equal ids draw equal copies; rows without an
id draw by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, text_or_empty, unit_hash, unused, written

SEED = "mix-1"
#: The greatest rate of one draw: its table is short, and exp(-rate) far from the least double.
PART_RATE = 64.0


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, by: str = "bytes") -> DataFrame:
    """One row a source: source, size, weight (sums to 1), rate."""
    size = F.octet_length(text_or_empty()).cast("long") if by == "bytes" else F.lit(1).cast("long")
    sizes = docs.groupBy("source").agg(F.sum(size).alias("size"))
    given = F.lit(None).cast("double")
    for name, weight in (weights or {}).items():
        given = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(given)
    sized = sizes.withColumn("given", given)
    over = sized.agg(F.sum("size").alias("total"), F.sum("given").alias("set"), F.sum(F.col("given").isNull().cast("int")).alias("free"), F.count(F.lit(1)).alias("n"))
    left = F.greatest(F.lit(1.0) - F.coalesce("set", F.lit(0.0)), F.lit(0.0))
    share = F.when(left > 0, left / F.col("free")).otherwise(F.col("set") / F.col("n"))
    weighed = sized.crossJoin(F.broadcast(over)).withColumn("raw", F.coalesce("given", share))  # one row, not a product
    whole = weighed.agg(F.sum("raw").alias("whole"))
    weighed = weighed.crossJoin(F.broadcast(whole)).withColumn("weight", F.col("raw") / F.col("whole"))
    rate = F.when(F.col("size") > 0, F.col("weight") * F.col("total") / F.col("size")).otherwise(F.lit(0.0))
    return weighed.select("source", "size", "weight", rate.alias("rate"))


def cumulative(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... as an array: of a distribution of which mass 2**-53 or less is left, no further count is tabled."""
    top = (rate + 12 * F.sqrt(rate) + 30).cast("int")

    def more(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["all"], F.array(F.element_at(acc["all"], -1) + p)).alias("all"))

    zero = F.exp(-rate)
    return F.aggregate(F.sequence(F.lit(1), top), F.struct(zero.alias("p"), F.array(zero).alias("all")), more)["all"]


def copies_of(u: Column, table: Column) -> Column:
    """The smallest k with u < P(X <= k)."""
    return F.size(F.filter(table, lambda c: c <= u))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, by: str = "bytes", seed: str = SEED) -> DataFrame:
    """Rows of docs, each as often as drawn, in a global random order.

    Returns the columns of docs, then copy (from 0), n_copies, rate and shuffle_key (0 to 1): partitions
    are dealt by the key and sorted by it. weights: of sources, None for equal weights. Columns of docs
    with one of these four names are replaced, all others are kept whatever their names.
    """
    n_parts = F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1)).cast("int")
    rates = written(source_rates(docs, weights, by), "mix-rates")
    data = docs.drop("copy", "n_copies", "rate", "shuffle_key")
    source, parts, table, name, counts, part, n, first = unused(data, "_source", "_parts", "_table", "_name", "_counts", "_part", "_n", "_first")
    rates = rates.select(F.col("source").alias(source), "rate", n_parts.alias(parts), cumulative(F.col("rate") / n_parts).alias(table))
    named = data.withColumn(name, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(text_or_empty()))))

    def drawn_in(at: Column) -> Column:
        u = F.when(at == 0, unit_hash(seed, F.col(name))).otherwise(unit_hash(seed, "part", F.col(name), at.cast("string")))
        return copies_of(u, F.col(table))

    columns = [quoted(c) for c in data.columns]
    drawn = (
        named.join(rates, named["source"].eqNullSafe(rates[source]))
        .withColumn(counts, F.transform(F.sequence(F.lit(0), F.col(parts) - 1), drawn_in))
        .withColumn("n_copies", F.aggregate(counts, F.lit(0), lambda a, x: a + x))
        # part by part, so that no array holds all copies; the copies of a part are numbered after those of the parts before it
        .select(*columns, name, "rate", "n_copies", counts, F.posexplode(counts).alias(part, n))
        .withColumn(first, F.aggregate(F.slice(counts, F.lit(1), F.col(part)), F.lit(0), lambda a, x: a + x))
        .withColumn("copy", F.explode(F.expr(f"case when {n} > 0 then sequence({first}, {first} + {n} - 1) else cast(array() as array<int>) end")))
    )
    key = unit_hash(seed, "order", F.col(name), F.col("copy").cast("string"))
    return drawn.select(*columns, "copy", "n_copies", "rate", key.alias("shuffle_key")).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
