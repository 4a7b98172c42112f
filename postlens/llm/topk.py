"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length (norm) into buckets, longest first. A query's seed threshold is its k-th
best score among the longest vectors, a set of bounded size. For a bucket with greatest norm m the query's
local cosine threshold is threshold / (|q| m): above 1 the bucket can't hold a result. Otherwise the bucket
picks a pruning by that cosine: length pruning (only vectors long enough, a prefix in norm order) when it
is low, and coordinate pruning as well (the query's strongest coordinates bound the product with the
Cauchy-Schwarz inequality on the rest) when it is high. What is left is multiplied in full.

Queries form blocks by their reach, the least norm that may hold a result; a block has as many queries as
fit `BLOCK_BYTES`. A block is sent to the buckets that one of its queries reaches, and a bucket's vectors
to those blocks alone, so a bucket that no query reaches does not move. Buckets are cut into chunks of
bounded size, so equal vectors or norms spread over tasks; each block and chunk gives at most k rows a query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE, K = 1024, 10
BUCKETS, CHUNK_ROWS, SEED_ROWS = 64, 65_536, 2048
#: Of a block's queries and of a chunk's vectors, as doubles. A query is sent to each chunk that its block reaches and a
#: vector to each block that reaches it, so both have one size.
BLOCK_BYTES = 1 << 25
#: From this local cosine on a bucket prunes by coordinates too, with so many of them.
COORDINATE_FROM, COORDINATES = 0.6, 8
_LONG = np.iinfo(np.int64)
#: No sum of products of doubles has more bits.
_BITS = 2 * 1024 + 64


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vectors: vec_id, embedding. Returns row (unique), vec_id, v (floor(scale * x) as doubles), norm, dim; unfit vectors are left out.

    Unfit: null, without an id, empty, or with a component that is null, not finite, or not finite once
    scaled as a double. From 2**53 on a double is whole, and floor would leave the range of longs.
    """

    def whole(e: Column) -> Column:
        x = e.cast("double") * scale
        return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)

    finite = ~F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double") * scale) == float("inf")))
    data = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(finite)
    data = data.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))
    return data.withColumns({"norm": norm, "dim": F.size("v")})


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while all sums stay below 2**53, else Python integers."""
    bound = q.shape[1] * np.abs(q).max(initial=0) * np.abs(v).max(initial=0)
    if bound < 2**53:
        return (q @ v.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return whole(q) @ whole(v).T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties to smaller ids; all that tie with the last one are looked at."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    if len(scores) > k:
        last = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= last)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _shown(scores: np.ndarray) -> tuple[list[int], list[bytes | None]]:
    """Scores held to the range of longs, and for those at its ends bytes that order as the scores do."""
    whole = [int(x) for x in scores]
    ends = [None if _LONG.min < x < _LONG.max else (x + (1 << _BITS)).to_bytes(_BITS // 8 + 1, "big") for x in whole]
    return [max(_LONG.min, min(_LONG.max, x)) for x in whole], ends


def _survivors(q: np.ndarray, q_norm: float, threshold: float, v: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Places in v (norms descending) that may reach the threshold."""
    if not np.isfinite([threshold, q_norm, norms[0], norms[0] ** 2, q_norm**2]).all() or threshold <= 0:
        return np.arange(len(v))
    if q_norm == 0:
        return np.arange(0)
    cosine = threshold / (q_norm * norms[0]) if norms[0] else np.inf
    # a hair below the threshold: norms are rounded
    long_enough = np.searchsorted(-norms, -(threshold * (1 - 1e-9) / q_norm), "right")
    if cosine < COORDINATE_FROM or v.shape[1] <= COORDINATES:
        return np.arange(long_enough)
    strong = np.argsort(-np.abs(q))[:COORDINATES]
    head = v[:long_enough, strong]
    rest = np.sqrt(np.maximum(norms[:long_enough] ** 2 - (head**2).sum(axis=1), 0)) * np.sqrt(max(q_norm**2 - (q[strong] ** 2).sum(), 0))
    return np.flatnonzero(head @ q[strong] + rest * (1 + 1e-9) + 1e-3 >= threshold * (1 - 1e-9))


def _seeded(queries: DataFrame, data: DataFrame, k: int, blocks: int) -> DataFrame:
    """queries with threshold: the k-th best score among the SEED_ROWS longest vectors of their dimension but their own, -inf if there are fewer."""
    longest = Window.partitionBy("dim").orderBy(F.desc("norm"), "vec_id", "row")  # each task sends its SEED_ROWS longest alone
    pool = data.withColumn("place", F.row_number().over(longest)).filter(F.col("place") <= SEED_ROWS).select("dim", "row", "v")
    pool = pool.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def seed(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        asked["threshold"] = -np.inf
        if len(asked) and len(held) >= k:
            own, ids = _matrix(held["v"]), held["row"].to_numpy()
            found = []
            for at in range(0, len(asked), 256):
                part = asked.iloc[at : at + 256]
                with np.errstate(over="ignore", invalid="ignore"):
                    scores = _products(_matrix(part["v"]), own)
                    scores = scores.astype(np.float64) if scores.dtype != object else np.full(scores.shape, np.nan)
                scores[part["row"].to_numpy()[:, None] == ids[None, :]] = -np.inf
                found.append(np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
            asked["threshold"] = np.nan_to_num(np.concatenate(found), nan=-np.inf)
        return asked.drop(columns="part")

    asked = queries.select("row", "vec_id", "v", "norm", "dim", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("part"))
    schema = "row long, vec_id long, v array<double>, norm double, dim int, threshold double"
    return asked.groupBy("dim", "part").cogroup(pool.groupBy("dim", "part")).applyInPandas(seed, schema)


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE) -> DataFrame:
    """vectors: vec_id, embedding; is_query: a condition on vec_id. Returns query_id, rank, vec_id, score.

    Candidates of a query: every fit row of its dimension but its own. Rows that repeat an id are candidates,
    and queries, as often. Scores are exact whole numbers; beyond a long they are shown as its end and ranked
    as they are. Fewer candidates than k give fewer rows, an empty table none. Other columns are not read.
    """
    data = written(integer_vectors(vectors, scale), "topk-vectors")
    summed = data.agg(F.percentile_approx("norm", [i / BUCKETS for i in range(1, BUCKETS)], 10_000).alias("e"), F.max("dim").alias("dim")).first()
    # buckets by descending norm; one row a bucket and dimension
    above = F.filter(F.lit(summed.e) if summed.e else F.expr("cast(array() as array<double>)"), lambda e: F.col("norm") <= e)
    data = data.withColumn("bucket", F.size(above))
    chunk_rows = F.least(F.lit(CHUNK_ROWS), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim"))).cast("int")))
    shape = data.groupBy("dim", "bucket").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("chunks"), F.max("norm").alias("top"))
    shape = written(shape, "topk-shape")

    queries = data.filter(is_query)
    block_rows = max(1, BLOCK_BYTES // (8 * (summed.dim or 1)))
    blocks = max(1, -(-queries.count() // block_rows))
    seeded = written(_seeded(queries, data, k, blocks), "topk-queries")
    # the least norm that may hold a result, a hair lower, as norms are rounded; 0 if the seeds tell nothing
    reach = F.when((F.col("threshold") > 0) & (F.col("threshold") < float("inf")) & (F.col("norm") > 0), F.col("threshold") * (1 - 1e-9) / F.col("norm")).otherwise(F.lit(0.0))
    seeded = seeded.withColumn("reach", reach)
    cuts = seeded.agg(F.percentile_approx("reach", [i / blocks for i in range(1, blocks)], 10_000).alias("e")).first().e if blocks > 1 else []
    of_reach = F.size(F.filter(F.lit(cuts), lambda e: F.col("reach") >= e)) if cuts else F.lit(0)
    # equal reaches share a number, so a part keeps the block's size
    sizes = seeded.withColumn("range", of_reach)
    parts = sizes.groupBy("dim", "range").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    placed = sizes.join(parts, ["dim", "range"]).withColumn("block", F.struct("range", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part")))
    placed = written(placed.drop("parts", "range"), "topk-blocks")
    # a row a block and bucket that it reaches
    least = placed.groupBy("dim", "block").agg(F.min("reach").alias("reach"))
    met = written(least.join(shape, "dim").filter(F.col("top") >= F.col("reach")).select("dim", "block", "bucket", "chunks"), "topk-met")
    asked = placed.join(met, ["dim", "block"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    whole = data.join(shape.drop("top"), ["dim", "bucket"]).withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int")).drop("chunks")
    cut = whole.join(met.drop("chunks"), ["dim", "bucket"])

    def search(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(rows):
            rows = rows.sort_values(["norm", "vec_id"], ascending=[False, True])
            v, norms, ids, own = _matrix(rows["v"]), rows["norm"].to_numpy(), rows["vec_id"].to_numpy(), rows["row"].to_numpy()
            for row, query_id, q, q_norm, threshold in zip(*(asked[c] for c in ("row", "vec_id", "v", "norm", "threshold")), strict=True):
                q = np.asarray(q, np.float64)
                with np.errstate(over="ignore", invalid="ignore"):
                    at = _survivors(q, q_norm, threshold, v, norms)
                    at = at[own[at] != row]
                    scores = _products(q[None, :], v[at])[0]
                best = _best(scores, ids[at], k)
                shown, ends = _shown(scores[best])
                out.append(pd.DataFrame({"row": row, "query_id": query_id, "vec_id": ids[at[best]], "score": shown, "end": ends}))
        columns = ["row", "query_id", "vec_id", "score", "end"]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: pd.Series([], dtype=object if c == "end" else "int64") for c in columns})

    keys = ["dim", "bucket", "chunk", "block"]
    found = asked.select(*keys, "row", "vec_id", "v", "norm", "threshold").groupBy(*keys).cogroup(cut.select(*keys, "row", "vec_id", "v", "norm").groupBy(*keys))
    found = found.applyInPandas(search, "row long, query_id long, vec_id long, score long, end binary")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.desc("end"), F.col("vec_id"))
    # the greatest long itself has bytes too, so those beyond it come first
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
