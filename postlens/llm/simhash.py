"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Fingerprints have eight positional bytes. Two that differ in at most k bits differ in at most k bytes,
so they share at least 8 - k of them: the guaranteed minimum of matches. Lists of single bytes would
hold N/256 fingerprints each, so a posting joins the bytes of several positions: the positions form
k + 2 groups, any pair in question shares at least two whole groups, and each pair of groups is one
index. Pairs met in a list are tallied by their shared positional bytes, kept from the minimum on, and
verified by their differing bits.

A list longer than `list_cap` emits no pairs. Its fingerprints are linked by an exact other way, in
proportion to their number: two fingerprints differ in at most two bits exactly if they share a
fingerprint at distance one or less, so each is joined to the least owner of each of its 65 variants.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import similar
from .common import written
from .graph import components

SHINGLE, SEED, BITS, LIST_CAP = 3, 42, 2, 200
#: Shingle hashes that are counted at once.
BLOCK = 65_536


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Of UTF-8 text; bytes.lower and bytes.split know ASCII letters and white space alone, as wanted here."""
    words = text.lower().split()
    if not words:
        return 0
    parts = [words] if len(words) < shingle else zip(*(words[i:] for i in range(shingle)))
    digest, n, ones = xxhash.xxh64_intdigest, 0, np.zeros(64, np.int64)
    hashes: list[int] = []
    for part in parts:
        hashes.append(digest(b" ".join(part), seed))
        if len(hashes) == BLOCK:
            n, ones, hashes = n + BLOCK, ones + _ones(hashes), []
    if hashes:
        n, ones = n + len(hashes), ones + _ones(hashes)
    return int(np.packbits((2 * ones > n).astype(np.uint8)).view(">u8")[0])


def _ones(hashes: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long). Null texts have no words, so fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()) if len(batch) else []
            fps = np.array([fingerprint(t.as_py() or b"", shingle, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _byte(fp: Column, at: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * at).bitwiseAND(F.lit(255))


def _keys(fp: Column, bits: int) -> Column:
    """One key for each pair of position groups: the pair's number and its bytes, hashed to a long."""
    groups = np.array_split(np.arange(8), bits + 2)
    return F.array(*[F.xxhash64(F.lit(i), *[_byte(fp, int(p)) for g in pair for p in groups[g]]) for i, pair in enumerate(combinations(range(len(groups)), 2))])


def links(nodes: DataFrame, bits: int = BITS, list_cap: int = LIST_CAP) -> DataFrame:
    """nodes: distinct fp. Returns u, v: links that join the same components as all pairs within `bits` bits.

    Lists over the cap need bits of 2 or less; others raise an error rather than lose links.
    """
    postings = nodes.select("fp", F.explode(_keys(F.col("fp"), bits)).alias("key"))
    sizes = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    listed = written(postings.join(sizes, "key"), "simhash-postings")
    a = listed.filter(F.col("n") <= list_cap)
    left, right = a.select("key", F.col("fp").alias("u")), a.select("key", F.col("fp").alias("v"))
    shared = sum((_byte(F.col("u"), p) == _byte(F.col("v"), p)).cast("int") for p in range(8))
    differ = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    pairs = left.join(right, "key").filter("u > v").filter(shared >= 8 - bits).filter(differ <= bits).select("u", "v").distinct()
    crowd = listed.filter(F.col("n") > list_cap).select("fp").distinct()
    if bits > 2:
        if not crowd.isEmpty():
            raise ValueError("lists over the cap can be linked exactly for 2 bits or fewer only")
        return pairs
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), i)) for i in range(64)]
    if bits < 2:
        flips = [F.least(flips[0], x) for x in flips[1:]] if bits else flips[:1]
    variants = crowd.select("fp", F.explode(F.array(*flips)).alias("near"))
    owners = variants.groupBy("near").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = variants.join(owners, "near").filter("fp <> v").select(F.col("fp").alias("u"), "v").distinct()
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, seed: int = SEED, list_cap: int = LIST_CAP) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links reach. Equal fingerprints are one node, so groups of
    copies and repeated rows cost one node each. Null ids follow their group; an empty table gives none.
    """
    slim = written(fingerprints(docs, shingle, seed), "simhash-fingerprints")
    nodes = slim.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = written(components(links(nodes.select("fp"), bits, list_cap)), "simhash-roots")
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = written(named, "simhash-named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.join(least, "root").select("fp", "component_id")
    return slim.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that stay, with their columns: of each component the rows of its smallest doc_id.

    Rows that repeat an id stay or go together.
    """
    gone = near_duplicates(docs, **how).filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")


def linked_pairs(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, seed: int = SEED, list_cap: int = LIST_CAP) -> DataFrame:
    """doc, other: each document with the least of its fingerprint, and these where `links` joins their fingerprints."""
    slim = written(fingerprints(docs, shingle, seed).filter("doc_id is not null"), "simhash-fingerprints")
    nodes = written(slim.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    equal = slim.join(nodes, "fp").filter("doc_id <> first").select(F.col("doc_id").alias("doc"), F.col("first").alias("other"))
    of_u, of_v = nodes.select(F.col("fp").alias("u"), F.col("first").alias("doc")), nodes.select(F.col("fp").alias("v"), F.col("first").alias("other"))
    near = links(nodes.select("fp"), bits, list_cap).join(of_u, "u").join(of_v, "v").select("doc", "other")
    return equal.unionByName(near).distinct()


def keep_dissimilar(docs: DataFrame, words: int = similar.WORDS, similarity: float = similar.SIMILARITY) -> DataFrame:
    """The rows of docs that stay when groups of texts alike in their word shingles keep their smallest doc_id.

    Candidates are the links of this module's index on fingerprints of `words`-word shingles and the bands
    of `similar`, which meets what lies further apart; each pair is verified on its whole sets, so documents
    below the similarity stay. Rows that repeat an id stay or go together; rows without an id stay.
    """
    close = linked_pairs(docs, shingle=words)
    groups = written(similar.groups(docs.select("doc_id", "text"), close, words, similarity), "similar-groups")
    gone = groups.filter("node <> root").select(F.col("node").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
