"""Repeated byte strings through a sparse suffix order.

A byte goes when some string of `length` bytes that covers it starts at two places or more. Sorting all
suffixes would move `length` bytes for each byte of text, so suffixes that can't repeat are left out
first, exactly:

0. Of equal texts one goes on, with weight two: the others repeat whole.
1. Every window of `length` bytes has an anchor, its leftmost `gram`-byte string of least hash. Equal
   windows have equal anchors at equal places. Neighbouring windows with the same anchor form a run of
   one context (their bytes together). Runs are rows: hash of the anchor, digest of the context.
2. A run whose anchor is met once repeats nowhere. A run whose context is met again repeats whole.
3. What is left are runs with a known anchor in a new context: the edges of repeats. They are cut into
   parts of STEP windows by the distance to the anchor. A part whose core (the bytes that all its windows
   share) is met once repeats nowhere, one whose hull (all its bytes) is met again repeats whole.
4. Parts of one core and several hulls have their windows spelt out as suffixes of `length` bytes. Sampled
   splitters range-partition the suffixes by their leading bytes, each bucket sorts its own by multikey quicksort
   on tokens of eight bytes, and equal neighbours repeat: whole byte strings are compared. A frequent suffix may
   straddle buckets, so the first and last suffixes of each bucket are compared with those of the others.

The digests of steps 1 to 3 have 128 bits. Groups that grow with the input (a common passage, many copies)
are counted with partial aggregation and never gathered. Texts are keyed by their 128-bit digest, so
repeated ids or rows do no harm. Columns of docs other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

LENGTH, GRAM = 400, 128
STEP = 17
#: Windows that are hashed at once; the low bits of a packed hash hold a place in such a block.
BLOCK = 1 << 20
BUCKET_ROWS, LEAD = 50_000, 16
#: Up to so many digests (16 bytes each) are broadcast; beyond it both sides are shuffled.
BROADCAST_DIGESTS = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    if not _TABLES:
        size = BLOCK + 4096
        for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _TABLES[name] = np.cumprod(steps, dtype=np.uint64)
        _TABLES["byte"] = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
    return _TABLES


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    t = _tables()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(t["byte"][data] * t["power"][: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * t["inverse"][: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each `width` neighbours, from running minima of blocks in both directions."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of texts that lie one behind the other in at most BLOCK + length bytes: first window, last window,
    anchor (places in data) and anchor hash of each run. Windows across texts are left out."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.int64),)
    hashes = _gram_hashes(data, gram)
    low = np.uint64(2 * BLOCK - 1)
    packed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (_window_min(packed, length - gram + 1) & low).astype(np.int64)
    whole = np.zeros(len(data) + 2, np.int32)
    fits = ends - starts >= length
    np.add.at(whole, starts[fits], 1)
    np.add.at(whole, ends[fits] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(whole[: len(anchor)]) > 0)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.int64),)
    a = anchor[at]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)]))
    first, last, place = at[new], at[np.concatenate([new[1:], [len(at)]]) - 1], a[new]
    return first, last, place, hashes[place].view(np.int64)


def _blocks(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Parts of a batch's second column (bytes): data and (row, start in data, end in data, place in its text)."""
    parts, size, spans = [], 0, []
    for row, text in enumerate(batch.column(1)):
        raw = np.frombuffer(text.as_buffer() or b"", np.uint8)
        for place in range(0, max(1, len(raw) - length + 1), BLOCK):
            part = raw[place : place + BLOCK + length - 1]
            if size and size + len(part) > BLOCK:
                yield np.concatenate(parts), spans
                parts, size, spans = [], 0, []
            parts.append(part)
            spans.append((row, size, size + len(part), place))
            size += len(part)
    if parts:
        yield np.concatenate(parts), spans


def _context(raw: memoryview, first: int, last: int, anchor: int, length: int) -> bytes:
    return hashlib.blake2b(raw[first : last + length], digest_size=16, key=(anchor - first).to_bytes(4, "little")).digest()


def anchored(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """texts: t (key), raw (binary), weight. Returns t, first, last (windows, places in the text), left (first to the anchor), anchor (hash), context (digest), weight."""
    names = ["t", "first", "last", "left", "anchor", "context", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, weights = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for data, spans in _blocks(batch, length):
                starts, ends = np.array([s[1] for s in spans]), np.array([s[2] for s in spans])
                first, last, place, hashes = runs(data, starts, ends, length, gram)
                owner = np.searchsorted(starts, first, "right") - 1
                raw = memoryview(data)
                digests = [_context(raw, *x, length) for x in zip(first.tolist(), last.tolist(), place.tolist(), strict=True)]
                shift = np.array([s[3] - s[1] for s in spans], np.int64)[owner] if len(first) else first
                rows = [spans[o][0] for o in owner.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[r] for r in rows], pa.binary()), pa.array(first + shift, pa.int64()), pa.array(last + shift, pa.int64()), pa.array((place - first).astype(np.int32), pa.int32()), pa.array(hashes, pa.int64()), pa.array(digests, pa.binary()), pa.array([weights[r] for r in rows], pa.int64())], names
                )

    return texts.select("t", "raw", "weight").mapInArrow(run, "t binary, first long, last long, left int, anchor long, context binary, weight long")


def multikey_quicksort(tokens: np.ndarray) -> np.ndarray:
    """Order of the rows of tokens (n x k, unsigned): three parts by a pivot token, the middle one on to the next token."""
    out, todo = [], [(np.arange(len(tokens)), 0)]
    while todo:
        rows, depth = todo.pop()
        if depth == tokens.shape[1] or len(rows) < 2:
            out.append(rows)
        elif len(rows) < 64:
            out.append(rows[np.lexsort(tokens[rows][:, depth:][:, ::-1].T)])
        else:
            own = tokens[rows, depth]
            pivot = np.sort(own[[0, len(own) // 2, -1]])[1]
            less, more = own < pivot, own > pivot
            todo += [(rows[more], depth), (rows[~less & ~more], depth + 1), (rows[less], depth)]
    return np.concatenate(out) if out else np.arange(0)


def _parts(reps: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """reps: t, first, last, left, anchor, context. One row a part: t, begin, end (windows), offset (begin from the run's first), anchor, context, sub, core, hull."""
    wanted = reps.groupBy("t").agg(F.collect_list(F.struct("first", "last", "left", "anchor", "context")).alias("wanted"))  # bounded by a text's length
    names = ["t", "begin", "end", "offset", "anchor", "context", "sub", "core", "hull"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary()]

    def of(t: bytes, raw: bytes, w: dict) -> Iterator[tuple]:
        at = w["first"] + w["left"]
        for sub in range((at - w["last"]) // STEP, w["left"] // STEP + 1):
            near, far = sub * STEP, sub * STEP + STEP - 1
            begin, end = max(w["first"], at - far), min(w["last"], at - near)
            core = xxhash.xxh3_64_intdigest(raw[at - near : at - far + length]) - (1 << 63)
            hull = hashlib.blake2b(raw[begin : end + length], digest_size=16, key=b"%d %d" % (at - end, at - begin)).digest()
            yield t, begin, end, begin - w["first"], w["anchor"], w["context"], sub, core, hull

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for t, raw, wanted in zip(*batch.columns, strict=True):
                t, raw = t.as_py(), raw.as_buffer().to_pybytes()
                for w in wanted.as_py():
                    rows += of(t, raw, w)
                    if len(rows) >= 20_000:
                        yield batch_of()
                        rows = []
        if rows:
            yield batch_of()

    schema = "t binary, begin long, end long, offset int, anchor long, context binary, sub int, core long, hull binary"
    return texts.join(wanted, "t").select("t", "raw", "wanted").mapInArrow(run, schema)


def _suffixes(reps: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """reps: t, begin, end, anchor, hull. One row a window: suffix (its bytes), anchor, hull, at (from begin)."""
    wanted = reps.groupBy("t").agg(F.collect_list(F.struct("begin", "end", "anchor", "hull")).alias("wanted"))  # bounded by a text's length
    names = ["suffix", "anchor", "hull", "at"]
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for raw, wanted in zip(batch.column(0), batch.column(1), strict=True):
                raw = raw.as_buffer().to_pybytes()
                for w in wanted.as_py():
                    rows += [(raw[at : at + length], w["anchor"], w["hull"], at - w["begin"]) for at in range(w["begin"], w["end"] + 1)]
                    if len(rows) >= 10_000:
                        yield batch_of()
                        rows = []
        if rows:
            yield batch_of()

    return texts.join(wanted, "t").select("raw", "wanted").mapInArrow(run, "suffix binary, anchor long, hull binary, at int")


def _tokens(suffixes: pa.Array) -> np.ndarray:
    """A row a suffix (all of one length, none null): its bytes as unsigned numbers of eight bytes each."""
    size = len(suffixes[0].as_buffer())
    padded = np.zeros((len(suffixes), -(-size // 8) * 8), np.uint8)
    padded[:, :size] = np.frombuffer(b"".join(x.as_buffer() for x in suffixes), np.uint8).reshape(-1, size)
    return padded.view(">u8").astype(np.uint64)


def _repeated(suffixes: DataFrame, rows: int) -> DataFrame:
    """suffixes: suffix (all of one length), anchor, hull, at; rows: their number. anchor, hull, at of those that are met twice or more."""
    buckets = max(1, -(-rows // BUCKET_ROWS))
    names = ["suffix", "lead", "tie", "anchor", "hull", "at", "repeats", "edge"]
    key = ["lead", "tie"]
    keyed = suffixes.select("suffix", F.substring("suffix", 1, LEAD).alias("lead"), F.xxhash64("suffix").alias("tie"), "anchor", "hull", "at")
    # splitters are sampled leading tokens; then a hash and the whole row, as one lead or one suffix may fill many buckets
    dealt = keyed.repartitionByRange(buckets, *key, "anchor", "hull", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if len(b)]  # a bucket, of BUCKET_ROWS rows or so
        if not parts:
            return
        rows = pa.Table.from_batches(parts).combine_chunks()
        tokens = _tokens(rows.column("suffix").combine_chunks())
        order = multikey_quicksort(tokens)
        tokens = tokens[order]
        same = (tokens[1:] == tokens[:-1]).all(axis=1)
        repeats = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        # the first and the last key of the bucket in the order of the splitters: unsigned bytes, then signed longs
        keys = list(zip(*(rows.column(c).to_pylist() for c in key), strict=True))
        ends = {min(keys), max(keys)}
        edge = np.array([k in ends for k in keys])[order]
        keep = np.flatnonzero(repeats | edge)
        rows, repeats, edge = rows.take(order[keep]), repeats[keep], edge[keep]
        # a suffix that is no edge is settled here, so its bytes need not travel on
        at_edge = pc.if_else(pa.array(edge), rows.column("suffix").combine_chunks(), pa.scalar(None, pa.binary()))
        columns = [at_edge, *[rows.column(c).combine_chunks() for c in names[1:6]], pa.array(repeats), pa.array(edge)]
        yield from pa.table(columns, names).to_batches()

    found = dealt.mapInArrow(run, "suffix binary, lead binary, tie long, anchor long, hull binary, at int, repeats boolean, edge boolean")
    found = written(found.drop(*key), "suffix-repeats")
    # across boundaries: an edge that is alone in its bucket repeats if another bucket has it as an edge
    lone = found.filter("edge and not repeats")
    edges = found.filter("edge").groupBy("suffix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    straddling = lone.join(edges, "suffix", "left_semi")
    return found.filter("repeats").unionByName(straddling).select("anchor", "hull", "at")


def _stretches(windows: DataFrame, length: int) -> DataFrame:
    """windows: anchor, hull, at. Returns anchor, hull, a, b: runs of windows that overlap or touch, from the first one's start to the last one's.

    The window function needs the partitioning that the join by hull needs anyway.
    """
    w = Window.partitionBy("anchor", "hull").orderBy("at")
    opens = (F.col("at") - F.lag("at").over(w) > length).cast("long")
    runs = windows.withColumn("opens", opens).withColumn("run", F.coalesce(F.sum("opens").over(w), F.lit(0)))
    return runs.groupBy("anchor", "hull", "run").agg(F.min("at").alias("a"), F.max("at").alias("b")).drop("run")


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    """Bytes and maximal runs that spans (start, stop) cover, and the digest of the rest."""
    removed, count, end, rest = 0, 0, 0, hashlib.sha256()
    for start, stop in sorted(spans):
        if start > end or count == 0:
            rest.update(raw[end:start])
            count += 1
            removed += stop - start
        elif stop > end:
            removed += stop - end
        end = max(end, stop)
    rest.update(raw[end:])
    return removed, count, rest.hexdigest()


def _small(keys: DataFrame) -> DataFrame:
    """keys (a written table), marked for broadcast if its counted rows allow it."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_DIGESTS else keys


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """spans (t, spans: array of start, stop in bytes, overlapping), the texts they are of (t, raw), one row a text,
    and copies (t): texts of `length` bytes or more that are there twice or more, which repeat whole and have no spans."""
    raw = text_or_empty().cast("binary")
    texts = docs.select("doc_id", F.unhex(F.md5(raw)).alias("t"), raw.alias("raw")).filter(F.octet_length("raw") >= length)
    copies = texts.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).filter("n > 1")
    copies = written(copies.select("t", "least"), "suffix-copies")
    # rows that repeat the least id go on together, which changes no count from one to two
    ones = texts.join(_small(copies.withColumn("copied", F.lit(True))), "t", "left").filter(F.col("copied").isNull() | F.col("doc_id").eqNullSafe(F.col("least")))
    ones = ones.select("t", "raw", F.when(F.col("copied"), 2).otherwise(1).cast("long").alias("weight"))
    rows = written(anchored(ones, length, gram), "suffix-anchors")
    contexts = rows.groupBy("anchor", "context").agg(F.sum("weight").alias("n"))
    known = contexts.groupBy("anchor").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).filter("total > 1")
    contexts = written(contexts.join(known, "anchor").select("anchor", "context", "n", "kinds"), "suffix-contexts")
    met = written(rows.join(contexts, ["anchor", "context"]), "suffix-met")

    asked = met.filter("weight = 1 or kinds > 1").select("t").distinct()
    own = written(ones.join(asked, "t", "left_semi").select("t", "raw").dropDuplicates(["t"]), "suffix-texts")
    new = met.filter("kinds > 1").groupBy("anchor", "context").agg(F.min(F.struct("t", "first", "last", "left")).alias("r")).select("r.*", "anchor", "context")
    parts = written(_parts(new, own, length), "suffix-parts")
    core = ["anchor", "sub", "core"]
    cores = parts.groupBy(*core).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*core)
    live = written(parts.join(cores, core, "left_semi"), "suffix-live")
    hulls = written(live.groupBy(*core, "hull").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "begin", "end")).alias("r")), "suffix-hulls")
    mixed = hulls.groupBy(*core).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*core)
    spelt = written(hulls.join(mixed, core, "left_semi").select("r.*", "anchor", "hull"), "suffix-spelt")
    windows = spelt.agg(F.coalesce(F.sum(F.col("end") - F.col("begin") + 1), F.lit(0)).alias("n")).first().n
    again = _stretches(_repeated(_suffixes(spelt, own, length), windows), length)
    size = F.col("end") - F.col("begin")
    inside = (
        live.join(hulls.filter("n > 1").select("anchor", "hull"), ["anchor", "hull"])
        .select("anchor", "context", F.col("offset").alias("a"), (F.col("offset") + size).alias("b"))
        .unionByName(live.join(again, ["anchor", "hull"]).select("anchor", "context", (F.col("offset") + F.col("a")).alias("a"), (F.col("offset") + F.col("b")).alias("b")))
    )
    met = met.filter("weight = 1")
    whole = met.filter("n > 1").select("t", "first", (F.col("last") + length).alias("stop"))
    part = met.filter("n = 1").join(inside, ["anchor", "context"]).select("t", (F.col("first") + F.col("a")).alias("first"), (F.col("first") + F.col("b") + length).alias("stop"))
    spans = whole.unionByName(part).groupBy("t").agg(F.collect_set(F.struct(F.col("first").alias("start"), "stop")).alias("spans"))  # bounded by a text's length
    return spans, own, copies.select("t")


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (binary) if asked for.

    Null texts are empty. Texts shorter than `length` bytes and an empty table need no work.
    """
    spans, own, copies = repeated_spans(docs, length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(raw.as_buffer().to_pybytes(), [(s["start"], s["stop"]) for s in spans.as_py()]) for raw, spans in zip(batch.column(1), batch.column(2), strict=True)]
            cut = [_cut(*x) for x in rows]
            arrays = [batch.column(0), pa.array([x[0] for x in cut], pa.int64()), pa.array([x[1] for x in cut], pa.int64()), pa.array([x[2] for x in cut], pa.string())]
            if with_text:
                arrays.append(pa.array([_rest(*x) for x in rows], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["t", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    schema = "t binary, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    changed = own.join(spans, "t").select("t", "raw", "spans").mapInArrow(run, schema)
    nothing = [F.lit(-1).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), *[F.lit(b"").alias("kept")] * with_text]
    # a table of its own, so that the rows of a frequent text may be joined with it in several tasks
    changed = written(changed.unionByName(copies.select("t", *nothing)), "suffix-changed")
    text = text_or_empty().cast("binary")
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.md5(text)).alias("t"), F.sha2(text, 256).alias("same"), *[text.alias("raw")] * with_text)
    removed = F.when(F.col("n_removed") < 0, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed")
    return rows.join(changed, "t", "left").select(
        "doc_id", "n_bytes", removed, F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "same").alias("kept_sha256"), *[F.coalesce("kept", "raw").alias("kept")] * with_text
    )


def _rest(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, end = [], 0
    for start, stop in sorted(spans):
        out.append(raw[end : max(end, start)])
        end = max(end, stop)
    return b"".join([*out, raw[end:]])
