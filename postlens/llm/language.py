"""Language ID: a byte convolutional network, trained and applied in numpy.

A text's UTF-8 bytes are cut into windows of WINDOW bytes, the last one padded. Bytes are embedded, filters
of several widths slide over a window, each filter's greatest value is kept, and a softmax over the learned
languages follows. A text's score for a language is the mean over all its windows, so whole texts count and
a foreign passage weighs as much as it is long.

Training takes at most about `max_windows` distinct windows (a documented bound), as many of each language
as there are: a window's own hash decides whether it is drawn, so windows come from all places of all
labelled texts, and copies are drawn once. That sample of some MB is one task's work. Prediction reads
every text in batches of windows, so memory doesn't depend on a text's length beyond the text itself.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, written

WINDOW, DIM = 256, 8
WIDTHS, FILTERS = (2, 3, 4), 16
REACH, PAD = max(WIDTHS), 256
MAX_WINDOWS, EPOCHS, BATCH, RATE = 32_768, 5, 64, 0.004
#: Windows of a batch in prediction: their patches stay in a core's cache.
AT_ONCE = 64
UNKNOWN = "und"


class Network:
    """Weights by name: embedding, filters, bias, out, out_bias; langs are the classes in order."""

    def __init__(self, langs: list[str], seed: int = 7):
        rnd = np.random.default_rng(seed)
        many = len(WIDTHS) * FILTERS
        self.langs = langs
        #: A filter of less than the greatest reach has zeros behind its width.
        self.mask = np.concatenate([np.repeat((np.arange(REACH) < w).astype(np.float32), DIM)[:, None].repeat(FILTERS, 1) for w in WIDTHS], 1)
        normal = lambda *shape, scale: (rnd.standard_normal(shape) * scale).astype(np.float32)
        self.w = {
            "embedding": normal(PAD + 1, DIM, scale=0.5), "filters": normal(REACH * DIM, many, scale=(REACH * DIM) ** -0.5) * self.mask, "bias": np.zeros(many, np.float32),
            "out": normal(many, len(langs), scale=many**-0.5), "out_bias": np.zeros(len(langs), np.float32),
        }
        self.w["embedding"][PAD] = 0

    def convolved(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Patches (windows, places, REACH * DIM) and the filters' values (windows, places, filters)."""
        n, length = windows.shape
        x = np.zeros((n, length + REACH - 1, DIM), self.w["embedding"].dtype)
        x[:, :length] = self.w["embedding"][windows]
        patches = np.lib.stride_tricks.as_strided(x, (n, length, REACH * DIM), x.strides).reshape(n * length, REACH * DIM)
        return patches.reshape(n, length, -1), (patches @ self.w["filters"]).reshape(n, length, -1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        pooled = np.maximum(self.convolved(windows)[1].max(1) + self.w["bias"], 0)
        return _softmax(pooled @ self.w["out"] + self.w["out_bias"])

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy; only the place of a filter's greatest value gets a share."""
        n = len(windows)
        patches, values = self.convolved(windows)
        best = values.argmax(1)
        pooled = np.take_along_axis(values, best[:, None], 1)[:, 0] + self.w["bias"]
        active = np.maximum(pooled, 0)
        wrong = _softmax(active @ self.w["out"] + self.w["out_bias"])
        wrong[np.arange(n), labels] -= 1
        wrong /= n
        back = (wrong @ self.w["out"].T) * (pooled > 0)
        met = patches[np.arange(n)[:, None], best]  # windows, filters, REACH * DIM
        embedding = np.zeros_like(self.w["embedding"])
        places = best[:, :, None] + np.arange(REACH)
        inside = places < windows.shape[1]
        at = np.where(inside, windows[np.arange(n)[:, None, None], np.minimum(places, windows.shape[1] - 1)], PAD)
        share = back[:, :, None] * self.w["filters"].T[None]
        np.add.at(embedding, at.ravel(), share.reshape(-1, DIM))
        embedding[PAD] = 0
        return {
            "embedding": embedding, "filters": np.einsum("nfk,nf->kf", met, back) * self.mask, "bias": back.sum(0),
            "out": active.T @ wrong, "out_bias": wrong.sum(0),
        }

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> None:
        """Adam with a falling rate. Some windows of each batch are cut short, so that short texts are learnt too."""
        rnd, step = np.random.default_rng(seed), 0
        mean, square = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        total = epochs * -(-len(windows) // BATCH)
        for _ in range(epochs):
            order = rnd.permutation(len(windows))
            for lo in range(0, len(order), BATCH):
                at = order[lo : lo + BATCH]
                batch = windows[at].copy()
                cut = np.where(rnd.random(len(at)) < 0.3, rnd.integers(12, WINDOW, len(at)), WINDOW)
                batch[np.arange(WINDOW)[None] >= cut[:, None]] = PAD
                step += 1
                rate = RATE * (1 - (step - 1) / total)
                for k, g in self.gradients(batch, labels[at]).items():
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.001 * (g * g - square[k])
                    self.w[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.w)
        return out.getvalue()

    @classmethod
    def unpacked(cls, langs: list[str], raw: bytes) -> Network:
        found = cls(langs)
        with np.load(io.BytesIO(raw)) as stored:
            found.w = {k: stored[k] for k in stored.files}
        return found


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def cut(raw: bytes | memoryview) -> np.ndarray:
    """All windows of raw, the last one padded; at least one."""
    n = max(1, -(-len(raw) // WINDOW))
    out = np.full(n * WINDOW, PAD, np.uint16)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 by 4: such rows are never learnt from. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, max_windows: int = MAX_WINDOWS) -> Network | None:
    """Learns lang from text of docs that are not held out; null languages and texts without a letter don't count.

    None if nothing can be learnt. One language alone is learnt as the only class.
    """
    known = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter(has_letter(F.col("text")))
    sizes = known.groupBy("lang").agg(F.sum(F.ceil(F.octet_length("text") / F.lit(WINDOW))).alias("n")).orderBy("lang").collect()  # a row a language
    if not sizes:
        return None
    langs = [r.lang for r in sizes]
    below = {r.lang: min(1.0, max_windows / len(langs) / int(r.n)) * 2**64 for r in sizes}

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw, limit = memoryview(text.as_py().encode()), below[lang]
                out += [(lang, w) for i in range(0, len(raw), WINDOW) if xxhash.xxh3_64_intdigest(w := bytes(raw[i : i + WINDOW])) < limit]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([w for _, w in out], pa.binary())], ["lang", "window"])

    drawn = written(known.mapInArrow(draw, "lang string, window binary").distinct(), "language-windows")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(turn=[xxhash.xxh3_64_intdigest(w, 1) for w in pdf["window"]]).sort_values(["turn", "lang"])
        number = {x: i for i, x in enumerate(langs)}
        net = Network(langs)
        net.train(np.concatenate([cut(w) for w in pdf["window"]]), pdf["lang"].map(number).to_numpy())
        return pd.DataFrame({"model": [net.packed()]})

    # one task: the sample has about max_windows rows of WINDOW bytes at most
    model = drawn.groupBy().applyInPandas(learn, "model binary").first()
    return Network.unpacked(langs, model.model) if model else None


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs (text, ...) with lang_pred and score added, in place of columns of those names.

    A null text and one without a letter give `und` and 0; so do all texts if there is no network.
    """
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast((net.langs, net.packed()) if net else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.unpacked(*sent.value) if sent.value else None
        for batch in batches:
            picked, scores = [UNKNOWN] * len(batch), [0.0] * len(batch)
            if net:
                sums, many = np.zeros((len(batch), len(net.langs))), np.zeros(len(batch))
                waiting: list[tuple[int, np.ndarray]] = []

                def settle(sums=sums, many=many, waiting=waiting) -> None:
                    owners = np.repeat([i for i, _ in waiting], [len(w) for _, w in waiting])
                    np.add.at(sums, owners, net.probabilities(np.concatenate([w for _, w in waiting])))
                    np.add.at(many, owners, 1)
                    waiting.clear()

                held = 0
                for i, text in enumerate(batch.column(0)):
                    if not text.is_valid:
                        continue
                    raw = memoryview(text.as_py().encode())
                    for lo in range(0, len(raw), WINDOW * AT_ONCE):
                        waiting.append((i, cut(raw[lo : lo + WINDOW * AT_ONCE])))
                        held += len(waiting[-1][1])
                        if held >= AT_ONCE:
                            settle()
                            held = 0
                if waiting:
                    settle()
                for i in np.flatnonzero(many):
                    best = int(sums[i].argmax())
                    picked[i], scores[i] = net.langs[best], min(1.0, float(sums[i, best] / many[i]))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(picked, pa.string()), pa.array(scores, pa.float64())], schema.names)

    # numbers for names: mapInArrow takes no names with dots
    schema = T.StructType([*[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    text = F.col("text").cast("string")
    plain = docs.select(F.when(has_letter(text), text).alias("read"), *[quoted(c).alias(f"c{i}") for i, c in enumerate(names)])
    return plain.mapInArrow(run, schema).toDF(*names, "lang_pred", "score")


def identify(docs: DataFrame, **how) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score. A null doc_id is not held out."""
    out = predict(docs.select("doc_id", "text"), fit(docs, **how))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
