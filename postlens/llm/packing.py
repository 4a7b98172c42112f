"""Best-fit packing of documents into sequences of a fixed length.

Documents are tokenized where they lie; only documents longer than a sequence are cut, into full pieces
behind a first piece that takes the rest. Full pieces are sequences of their own. The others are dealt
to groups by a hash and packed online by best fit: a bitset has bit f set while an open bin has f free
places, so the tightest bin that fits is the lowest set bit from the piece's length on. The number of
open bins is fixed; to open one more, the fullest closes.

Null texts count as empty; an empty text has the end token alone. Repeated rows are packed as often as
they come. An empty table gives none.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, written

LENGTH, END, OPEN_BINS, GROUP_ROWS = 1024, 2, 4096, 200_000
CACHED = 400_000

_loaded: dict[str, tuple] = {}


class _Words(dict):
    """Packed ids of words behind a space; when full it starts anew."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(" " + word)
        if len(word) <= 48:
            if len(self) >= CACHED:
                self.clear()
            self[word] = ids
        return ids


def encoder(path: str):
    """text -> little-endian unsigned 32-bit ids, as tokenizers.Tokenizer gives them for the same file.

    The vocabulary is byte-level BPE, whose pieces never cross a space before a word, so plain texts are
    encoded word by word with a bounded cache. tiktoken merges by the same ranks, which the file's merges
    state. Other texts are encoded whole; those whose runs of white space its pattern can't take (from
    some 10**6 characters on) by tokenizers itself.
    """
    if path not in _loaded:
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        plain = {ord(c): b for b, c in _byte_letters().items()}
        ranks = {bytes(plain[ord(c)] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        core = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def whole(text: str) -> bytes:
            try:
                ids = core.encode(text, allowed_special="all")
            except ValueError:
                ids = tokenizer().encode(text, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()

        @cache
        def tokenizer():
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            return Tokenizer.from_file(path)

        words = _Words(whole)
        odd = re.compile(r" (?:\s|$)|" + "|".join(map(re.escape, special)) if special else r" (?:\s|$)")

        def encode(text: str) -> bytes:
            if odd.search(text):
                return whole(text)
            first, *rest = text.split(" ")
            return b"".join(chain((whole(first),), map(words.__getitem__, rest)))

        _loaded[path] = encode
    return _loaded[path]


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: itself if printable, else from 256 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids: one row per piece, nothing moved."""
    tail = np.array([end], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows: list[list] = [[] for _ in names]
                for doc_id, text in zip(batch.column(0)[at : at + 256].to_pylist(), batch.column(1)[at : at + 256].to_pylist(), strict=True):
                    ids = encode(text or "") + tail
                    total = len(ids) // 4
                    start, stop, piece = 0, (total - 1) % length + 1, 0
                    while start < total:
                        own = ids[4 * start : 4 * stop]
                        for column, x in zip(rows, (doc_id, piece, start, stop - start, zlib.crc32(own), own), strict=False):
                            column.append(x)
                        start, stop, piece = stop, stop + length, piece + 1
                arrays = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *[pa.array(x, pa.int64()) for x in rows[2:5]]]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in rows[5]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def best_fit(lengths: Iterator[int], size: int = LENGTH, open_bins: int = OPEN_BINS) -> Iterator[tuple[int, int]]:
    """For each length the bin's number and the place in it; bounded state, one pass."""
    bits, free, opened, count = 0, [[] for _ in range(size + 1)], 0, 0
    for n in lengths:
        if fits := bits >> n << n:
            left = (fits & -fits).bit_length() - 1
            number = free[left].pop()
            if not free[left]:
                bits ^= 1 << left
        else:
            if opened == open_bins:
                fullest = (bits & -bits).bit_length() - 1
                free[fullest].pop()
                if not free[fullest]:
                    bits ^= 1 << fullest
                opened -= 1
            number, left = count, size
            count, opened = count + 1, opened + 1
        yield number, size - left
        if rest := left - n:
            free[rest].append(number)
            bits |= 1 << rest
        else:
            opened -= 1


def pack(cut: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32, ...).

    A group packs about group_rows pieces, as sorted, so that a task run anew gives the same bins.
    Columns of cut that are named sequence_id or offset are replaced; any other name is kept.
    """
    cut = cut.drop("sequence_id", "offset")
    named = cut.columns
    # numbers for other names: mapInArrow takes no names with dots
    needed = ["doc_id", "piece", "start", "length", "ids_crc32"]
    cut = cut.select(*[quoted(c).alias(c if c in needed else f"c{i}") for i, c in enumerate(named)])
    own = "group"
    cut = written(cut, "pieces")  # tokenized once, read three times
    open_rows = cut.filter(F.col("length") < length)
    groups = max(1, -(-open_rows.count() // group_rows))
    # the hash of the whole row deals repeated ids evenly too
    number = F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(groups))
    dealt = open_rows.withColumn(own, number).repartition(groups, own).sortWithinPartitions(own, F.xxhash64("doc_id", "piece"), *needed)
    columns = cut.columns
    names = [*columns, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, bins, feed = None, None, []
        for batch in batches:
            places = []
            for g, n in zip(batch.column(own).to_pylist(), batch.column("length").to_pylist(), strict=True):
                if g != group:
                    group, feed = g, []
                    bins = best_fit(iter(lambda feed=feed: feed.pop(), None), length, open_bins)
                feed.append(n)
                bin_, place = next(bins)
                places.append((2 * (bin_ * groups + g), place))
            ends = [pa.array([x[i] for x in places], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *ends], names)

    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    packed = dealt.mapInArrow(run, schema)
    # a full piece is a sequence: odd numbers, gaps are allowed
    full = cut.filter(F.col("length") == length).select(*columns, (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full).toDF(*named, "sequence_id", "offset")
