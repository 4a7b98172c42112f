"""Documents whose sets of word shingles are alike, for groups wider than a few bits of a SimHash.

Two bits of 64 hold a similarity of about 0.98 on shingles; at 0.8 the expected distance is ten bits, more
than the eight bytes of the position index can promise a match for. So pairs at a stated Jaccard similarity
are met by bands of minima beside the SimHash links, and every pair is verified on its full sets.

The documents of a band's bucket are first paired with two of them, the one that meets most others over
all bands (an original among its copies) and one drawn by hash, which differs by band. Pairs are thinned by
one byte a minimum, with 4.5 deviations of room, and verified in two steps: first each document's nearest
pair, then those pairs that these did not connect.

Then every bucket that still holds documents of several components is settled whole: all pairs across its
components are compared, in a short bucket as above, in a long one in cells of two of its parts, whose common
shingles are counted by matrix products on the whole sets. A cell returns the links of a spanning forest.
Pairs inside the component with most of a bucket's documents need no cell, as they are linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import components

WORDS, SIMILARITY = 5, 0.8
#: At a similarity of 0.8 a pair shares no band with a chance of 0.0007.
BANDS, ROWS = 24, 6
#: Shingles that are permuted at once.
BLOCK = 512
#: Buckets of up to so many documents emit their pairs; a part of a longer one has about so many documents and shingles.
SHORT, PART_DOCS, PART_SHINGLES = 32, 1024, 2_000_000
#: Shingles that are columns of one matrix product.
COLUMNS = 4096
_RNG = np.random.default_rng(20)
_A, _B = _RNG.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1), _RNG.integers(0, 2**63, BANDS * ROWS, np.uint64)
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words are one shingle, and so is no word."""
    tokens = text.lower().split()
    table = {w: xxhash.xxh64_intdigest(w) for w in set(tokens)}
    codes = np.fromiter(map(table.__getitem__, tokens), np.uint64, len(tokens))
    span = min(words, len(tokens))
    if not span:
        return np.zeros(1, np.uint64)
    width = len(tokens) - span + 1
    out = reduce(lambda h, j: h * _BASE + codes[j : j + width], range(span), np.zeros(width, np.uint64))
    out ^= out >> np.uint64(33)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return np.unique(out)


def minima(shingles: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        np.minimum(least, (_A[:, None] * shingles[at : at + BLOCK] + _B[:, None]).min(axis=1), out=least)
    return least


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc, bands (one hash each), minima (one byte each), size (of the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands, low, size = [], [], []
            for text in batch.column(1).cast(pa.binary()) if len(batch) else []:
                shingles = shingle_set(text.as_py() or b"", words)
                least = minima(shingles)
                keys = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))]
                bands.append(np.array(keys, np.uint64).view(np.int64))
                low.append((least >> np.uint64(24)).astype(np.uint8).tobytes())
                size.append(len(shingles))
            columns = [batch.column(0), pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.binary()), pa.array(size, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "bands", "minima", "size"])

    return docs.mapInArrow(run, "doc long, bands array<long>, minima binary, size long")


def _listed(sketches: DataFrame) -> DataFrame:
    """doc, size, key, n: the buckets of two or more."""
    postings = sketches.select("doc", "size", F.explode("bands").alias("key"))
    sizes = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return written(postings.join(sizes, "key"), "similar-postings")


def _met(listed: DataFrame) -> DataFrame:
    """doc, other: the documents of each bucket with its two chosen ones."""
    degree = listed.groupBy("doc").agg(F.sum("n").alias("degree"))
    chosen = listed.join(degree, "doc").groupBy("key").agg(
        F.max(F.struct("degree", (-F.col("doc")).alias("least"), "doc"))["doc"].alias("hub"),
        F.max(F.struct(F.xxhash64("doc", "key").alias("draw"), "doc"))["doc"].alias("drawn"),
    )
    both = listed.join(chosen, "key").select("doc", F.explode(F.array("hub", "drawn")).alias("other"))
    return both.filter("doc <> other").distinct()


def _thinned(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """doc, other, same: pairs whose equal bytes don't rule the similarity out."""
    n = BANDS * ROWS
    floor = n * (similarity - 4.5 * (similarity * (1 - similarity) / n) ** 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, n) for i in (2, 3))
            same = (a == b).sum(axis=1)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.int64())], ["doc", "other", "same"])
            yield out.filter(pa.array(same >= floor))

    a = sketches.select("doc", F.col("minima").alias("a"))
    b = sketches.select(F.col("doc").alias("other"), F.col("minima").alias("b"))
    return pairs.join(a, "doc").join(b, "other").select("doc", "other", "a", "b").mapInArrow(run, "doc long, other long, same long")


def _verified(pairs: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """u, v: the pairs whose sets of shingles reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())) if len(batch) else []:
                x, y = x.as_py() or b"", y.as_py() or b""
                if y != last:
                    last, known = y, shingle_set(y, words)
                mine = shingle_set(x, words)
                common = len(np.intersect1d(mine, known, assume_unique=True))
                keep.append(common >= similarity * (len(mine) + len(known) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    x = docs.select(F.col("doc").alias("u"), F.col("text").alias("x"))
    y = docs.select(F.col("doc").alias("v"), F.col("text").alias("y"))
    return pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of a with every set of b."""
    sets = a + b
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    kept = shared[at]
    row, column = row[kept], number[at[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, int(shared.sum()), COLUMNS):
        low, high = np.searchsorted(column, [start, start + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[row[low:high], column[low:high] - start] = 1
        common += held[: len(a)] @ held[len(a) :].T
    return common


def _forest(hits: np.ndarray) -> list[tuple[int, int]]:
    """Links (a, b) that join what all the true cells of hits (rows a, columns b) join."""
    links, new_a, new_b = [], np.ones(hits.shape[0], bool), np.ones(hits.shape[1], bool)
    for first in np.flatnonzero(hits.any(axis=1)):
        if not new_a[first]:
            continue
        new_a[first], todo = False, [(True, first)]
        while todo:
            of_a, x = todo.pop()
            new = new_b if of_a else new_a
            reached = np.flatnonzero((hits[x] if of_a else hits[:, x]) & new)
            new[reached] = False
            links += [(x, y) if of_a else (y, x) for y in reached]
            todo += [(not of_a, y) for y in reached]
    return links


def _settle(cell: pa.Table, words: int, similarity: float) -> pa.Table:
    """u, v: links across the components of one cell (columns p, q, part, doc, root, text)."""
    part, doc, root = (cell.column(c).to_numpy() for c in ("part", "doc", "root"))
    a, b = np.flatnonzero(part == cell.column("p")[0].as_py()), np.flatnonzero(part == cell.column("q")[0].as_py())
    u = v = np.zeros(0, np.int64)
    if len(a) and len(b):
        sets = [shingle_set(t.as_py() or b"", words) for t in cell.column("text").cast(pa.binary())]
        size = np.array([len(s) for s in sets])
        common = _common([sets[i] for i in a], [sets[i] for i in b]).astype(np.float64)
        hits = (common >= similarity * (size[a][:, None] + size[b] - common) - 1e-9) & (root[a][:, None] != root[b])
        links = np.array(_forest(hits), np.int64).reshape(-1, 2)
        u, v = doc[a[links[:, 0]]], doc[b[links[:, 1]]]
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _across(listed: DataFrame, roots: DataFrame, tried: DataFrame, sketches: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """u, v: links that join what all near pairs join that share a bucket and whose components differ.

    roots: node, root, the components so far; tried: u, v, pairs that these have settled.
    Buckets of two are settled by their chosen pairs.
    """
    of = roots.select(F.col("node").alias("doc"), "root").distinct()
    labelled = written(listed.filter("n > 2").join(of, "doc", "left").select("key", "n", "doc", "size", F.coalesce("root", "doc").alias("root")), "similar-labelled")
    tally = labelled.groupBy("key", "root").agg(F.count(F.lit(1)).alias("held"), F.sum("size").alias("weight"))
    most = F.max(F.struct("held", "weight", F.col("root").alias("most"))).alias("m")
    keys = tally.groupBy("key").agg(most, F.sum("weight").alias("whole"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("key", "whole", "m.*")
    still = written(labelled.join(keys, "key"), "similar-open")

    short = still.filter(F.col("n") <= SHORT)
    left, right = (short.select("key", F.col("doc").alias(c), F.col("root").alias(f"root_{c}")) for c in ("doc", "other"))
    pairs = left.join(right, "key").filter("doc > other and root_doc <> root_other").select("doc", "other").distinct()
    pairs = pairs.join(tried.select(F.col("u").alias("doc"), F.col("v").alias("other")), ["doc", "other"], "left_anti")
    few = _verified(_thinned(pairs, sketches, similarity).select(F.col("doc").alias("u"), F.col("other").alias("v")), docs, words, similarity)

    parts = lambda n, weight: F.ceil(F.greatest(n / PART_DOCS, weight / PART_SHINGLES)).cast("int")
    of_most = F.col("root") == F.col("most")
    cut = still.filter(F.col("n") > SHORT).withColumns({"g": parts(F.col("held"), F.col("weight")), "o": parts(F.col("n") - F.col("held"), F.col("whole") - F.col("weight"))})
    dealt = F.xxhash64("doc", F.lit("part"))
    cut = cut.withColumn("part", F.when(of_most, F.pmod(dealt, F.col("g"))).otherwise(F.col("g") + F.pmod(dealt, F.col("o"))).cast("int"))
    partner = F.explode(F.sequence(F.when(of_most, F.col("g")).otherwise(F.lit(0)), F.col("g") + F.col("o") - 1))
    cells = cut.select("key", "part", "doc", "root", partner.alias("partner"))
    cells = cells.select("key", F.least("part", "partner").alias("p"), F.greatest("part", "partner").alias("q"), "part", "doc", "root")
    many = cells.join(docs, "doc").groupBy("key", "p", "q").applyInArrow(lambda cell: _settle(cell, words, similarity), "u long, v long")
    return few.unionByName(many).distinct()


def groups(docs: DataFrame, more: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs: doc_id, text; more: doc, other, pairs met in another way. Returns node, root: the documents of
    groups of two or more and the least id that links reach.

    Null ids take no part. Null and empty texts are alike. Rows that repeat an id are one node, which links
    where one of their texts does. An empty table gives no rows.
    """
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    sketches = written(_sketches(docs, words), "similar-sketches")
    listed = _listed(sketches)
    pairs = _met(listed).unionByName(more.filter("doc <> other")).distinct()
    near = written(_thinned(pairs, sketches, similarity), "similar-pairs")
    ordered = lambda df: df.select(F.greatest("doc", "other").alias("u"), F.least("doc", "other").alias("v")).distinct()
    nearest = near.groupBy("doc").agg(F.max(F.struct("same", (-F.col("other")).alias("least"), "other"))["other"].alias("other"))
    first = written(_verified(ordered(nearest), docs, words, similarity), "similar-links")
    roots = written(components(first), "similar-roots")
    of_u, of_v = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "uv")
    apart = ordered(near).join(of_u, "u", "left").join(of_v, "v", "left").filter(F.coalesce("root_u", "u") != F.coalesce("root_v", "v"))
    # A pair tried in the first step and found too far apart is not tried again.
    rest = apart.select("u", "v").join(ordered(nearest), ["u", "v"], "left_anti")
    second = written(_verified(rest, docs, words, similarity), "similar-links")
    linked = lambda df: df.select(F.col("node").alias("u"), F.col("root").alias("v"))
    roots = written(components(linked(roots).unionByName(second)), "similar-roots")
    third = written(_across(listed, roots, ordered(near), sketches, docs, words, similarity), "similar-links")
    return components(linked(roots).unionByName(third))
