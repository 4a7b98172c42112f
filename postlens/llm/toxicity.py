"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are present or absent: words, pairs of neighbours, and pairs with one word between, hashed to
2**20 places. Each coordinate has its own rate, and L1 leaves most weights at zero, so the model is a
list of at most 2**20 (place, weight) pairs, which bounds the broadcast at 12 MB.

Training reads at most `max_rows` labelled rows (a documented bound: beyond it, those with the smallest
hashes), dealt to learners of about `rows_each` rows or `BYTES_EACH` bytes; their weights are averaged.
The hash of a row's id and text names its learner, that of its id its turn there, so the model doesn't
depend on partitions and an id that is there many times is no learner's alone. Scoring
reads every row and its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, unused, written

BITS = 20
MAX_ROWS, ROWS_EACH, BYTES_EACH, EPOCHS = 65_536, 8192, 1 << 27, 6
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.0
#: A toxic row counts as so many others in the gradient, as toxic rows are few.
TOXIC_WEIGHT = 3.0
#: The intercept's place and the log odds of a model without any labelled row.
INTERCEPT, NO_MODEL = -1, -10.0
_WORD = re.compile(r"[^\W_]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
CACHED = 300_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            if len(self) >= CACHED:
                self.clear()
            self[word] = h
        return h


_hashes = _Hashes()


def features(text: str) -> np.ndarray:
    """Places of all features of a text, repeats included."""
    words = _WORD.findall(text.lower())
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    shift = np.uint64(64 - BITS)
    found = [(h * _MIX[0]) >> shift]
    if len(h) > 1:
        found.append(((h[:-1] * _MIX[1]) ^ (h[1:] * _MIX[2])) * _MIX[0] >> shift)
    if len(h) > 2:
        found.append(((h[:-2] * _MIX[3]) ^ (h[2:] * _MIX[1])) * _MIX[0] >> shift)
    return np.concatenate(found).astype(np.int32)


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> dict[int, float]:
    """rows: (distinct places, label). Returns the weights that L1 leaves, and the intercept."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    bias_z = bias_n = 0.0
    for _ in range(epochs):
        for at, label in rows:
            w = weights(at)
            bias = -bias_z / ((BETA + bias_n**0.5) / ALPHA)
            g = (1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30))) - label) * (TOXIC_WEIGHT if label else 1.0)
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / ALPHA * bias
            bias_n += g * g
    some = np.flatnonzero(np.abs(z[:-1]) > L1)
    return dict(zip(some.tolist(), weights(some).tolist(), strict=True)) | {INTERCEPT: float(-bias_z / ((BETA + bias_n**0.5) / ALPHA))}


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves no rest by 5: such rows are never learnt from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, rows_each: int = ROWS_EACH) -> dict[int, float]:
    """Learns labels.toxic of docs (doc_id, text). Of several labels of an id the greatest counts; null labels don't."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("turn", F.xxhash64(F.lit("ftrl"), "id"))
    n = known.count()
    if n > max_rows:
        known = known.filter((F.col("turn") / float(2**64) + 0.5) < 0.97 * max_rows / n)
    slim = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # bounded by max_rows rows of 20 bytes; rows that repeat an id and its text are learnt once
    data = slim.join(F.broadcast(known), "id").select("turn", "text", "toxic").distinct().withColumn("deal", F.xxhash64("turn", "text"))
    data = written(data, "toxicity-rows")
    n = data.count()
    if n > max_rows:
        data = data.filter((F.col("deal") / float(2**64) + 0.5) < 0.97 * max_rows / n)
    size = data.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first().bytes
    learners = max(1, -(-min(n, max_rows) // rows_each), -(-size // BYTES_EACH))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["turn", "text"])
        w = ftrl([(np.unique(features(t)), int(y)) for t, y in zip(ordered["text"], ordered["toxic"], strict=True)])
        return pd.DataFrame({"place": list(w), "weight": list(w.values())})

    dealt = data.withColumn("learner", F.pmod("deal", F.lit(learners)))
    parts = dealt.groupBy("learner").applyInPandas(learn, "place int, weight double")
    parts = written(parts, "toxicity-weights")
    many = max(1, parts.filter(F.col("place") == INTERCEPT).count())
    # each place once: at most 2**20 rows
    return {r.place: r.weight / many for r in parts.groupBy("place").agg(F.sum("weight").alias("weight")).orderBy("place").collect()}


def _score(docs: DataFrame, model: dict[int, float], named: str) -> DataFrame:
    """docs with the score added as column `named`, which docs lacks."""
    table = np.zeros(1 << BITS)
    places = [p for p in model if p != INTERCEPT]
    table[places] = [model[p] for p in places]
    bias = model.get(INTERCEPT, NO_MODEL)
    sparse = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(table).astype(np.int32), table[np.flatnonzero(table)].astype(np.float64)))
    names = docs.columns
    # a text that is a string already goes to Python once
    given = isinstance(docs.select("text").schema[0].dataType, T.StringType)
    place = [c.lower() for c in names].index("text") if given else len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values = sparse.value
        w = np.zeros(1 << BITS)
        w[at] = values
        for batch in batches:
            scores = []
            for text in batch.column(place):
                places = features(text.as_py() or "")
                hit = np.unique(places[w[places] != 0])
                scores.append(1 / (1 + np.exp(-np.clip(w[hit].sum() + bias, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(scores, pa.float64())], schema.names)

    # numbers for names: mapInArrow takes no names with dots
    schema = T.StructType([*[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)], T.StructField("score", T.DoubleType())])
    plain = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)], *([] if given else [F.col("text").cast("string").alias("read")]))
    return plain.mapInArrow(run, schema).toDF(*names, named)


def score(docs: DataFrame, model: dict[int, float]) -> DataFrame:
    """docs (doc_id, text, ...) with score (0 to 1) added, in place of a column of that name; null texts score as empty ones."""
    return _score(docs.drop("score"), model, "score")


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 from 0.5 on). A null id is not held out."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, **how))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that the model does not reject, with all their columns, whatever their names."""
    (named,) = unused(docs, "_score")
    return _score(docs, fit(docs, labels, **how), named).filter(F.col(named) < 0.5).drop(named)
