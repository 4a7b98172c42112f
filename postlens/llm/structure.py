"""Conversation structure repair by square-root checkpointed dynamic programming.

A conversation is legal if the initials of its roles read `(s?(ua)+)?`. Edits: Keep costs 0, Rerole to user
or assistant 3, Delete 4 (a blank or repeated row must go), Insert of an empty user or assistant row 3; a
truncated row that stays adds 3. The cheapest edits are wanted, of several the ASCII-least string of initials.

What follows a row enters only as a vector of four costs, one a state (nothing yet, after s, after u, after a).
Rows are sorted by ranges of (conversation, turn, role, text), so a long conversation is cut into segments of
several tasks. Each segment tells how it turns a vector behind it into the one before it (a 4 x 4 matrix of
costs); one small row a segment is enough to find the vectors behind all segments. A segment then stores
vectors at every sqrt(n)-th row only and, walking forward, computes those between anew, block by block, to
take the ASCII-least of the tight edits, for each state that it may be entered in. A last pass over segments
links the states. So no conversation is gathered in a task; only its digest reads its rows in order, as a stream.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ASCII_SPACE, written

#: States: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAR = 1 << 50
#: Where a row of that initial leads from each state; None: not legal.
_AFTER = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
#: Where an inserted or reroled row leads: the role that the state asks for.
_NEXT = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")
BLANK, DUPLICATE, CUT, FINE = "blank", "duplicate", "truncated", ""

Kind = tuple[str, str]  # initial, first fault
Costs = tuple[int, int, int, int]


def _closed(costs: list[int]) -> Costs:
    """With rows inserted first where that is cheaper; more than two never are."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[_NEXT[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


def _shifted(costs: Costs) -> Costs:
    """Less the least; what can't be reached stays FAR, so that few vectors differ."""
    low = min(costs)
    return tuple(c - low if c < FAR // 2 else FAR for c in costs)


END = _closed([0, FAR, FAR, 0])


@lru_cache(1 << 16)
def _edits(kind: Kind, behind: Costs) -> tuple[tuple[tuple[int, str, int], ...], ...]:
    """Per state: (cost with what is behind, initial, next state) of each edit of a row."""
    initial, fault = kind
    out = []
    for s in range(4):
        mine = [(DELETE + behind[s], "D", s)]
        if fault not in (BLANK, DUPLICATE):
            stays = TRUNCATED if fault == CUT else 0
            to = _AFTER.get(initial, (None,) * 4)[s]
            if to is not None:
                mine.append((stays + behind[to], "K", to))
            mine.append((REROLE + stays + behind[_NEXT[s]], "R", _NEXT[s]))
        out.append(tuple(mine))
    return tuple(out)


@lru_cache(1 << 16)
def _before(kind: Kind, behind: Costs) -> tuple[Costs, int]:
    """Costs before a row, less their least, and that least."""
    costs = _closed([min(e[0] for e in mine) for mine in _edits(kind, behind)])
    return _shifted(costs), min(costs)


@lru_cache(1 << 16)
def _walked(kind: Kind, behind: Costs, state: int) -> tuple[str, int]:
    """The ASCII-least tight edits from before a row to behind it, rows inserted before it included, and the state behind."""
    edits, done = _edits(kind, behind), ""
    before = _closed([min(e[0] for e in mine) for mine in edits])
    while True:
        tight = [(e[1], e[2]) for e in edits[state] if e[0] == before[state]]
        if INSERT + before[_NEXT[state]] == before[state]:
            tight.append(("I", _NEXT[state]))
        letter, state = min(tight)
        done += letter
        if letter != "I":
            return done, state


def _tail(state: int) -> str:
    """Rows inserted at the end."""
    done = ""
    while END[state]:
        done, state = done + "I", _NEXT[state]
    return done


def vector_before(kinds: list[tuple[Kind, int]], behind: Costs) -> Costs:
    """Costs before rows given as (kind, further copies); each copy is a duplicate and must go."""
    total = min(behind)
    now = _shifted(behind)
    for kind, copies in reversed(kinds):
        now, low = _before(kind, now)
        total += low + DELETE * copies
    return tuple(c + total if c < FAR else FAR for c in now)


def walk(kinds: list[tuple[Kind, int]], behind: Costs, states: tuple[int, ...]) -> dict[int, tuple[int, str]]:
    """From each state before the rows: the state behind them and the ASCII-least cheapest edits.

    Vectors are kept at every sqrt(n)-th row; a block's own are computed anew when the walk gets there.
    """
    step = max(1, math.isqrt(len(kinds)))
    starts = range(0, len(kinds), step)
    now, checkpoints = _shifted(behind), {}
    for lo in reversed(starts):
        checkpoints[lo] = now
        for kind, _ in reversed(kinds[lo : lo + step]):
            now, _low = _before(kind, now)
    at, done = {s: s for s in states}, {s: [] for s in states}
    for lo in starts:
        block, vectors = kinds[lo : lo + step], [checkpoints[lo]]
        for kind, _ in reversed(block[1:]):
            vectors.append(_before(kind, vectors[-1])[0])
        for (kind, copies), vector in zip(block, reversed(vectors), strict=True):
            for s in states:
                letters, at[s] = _walked(kind, vector, at[s])
                done[s].append(letters + "D" * copies)
    return {s: (at[s], "".join(done[s])) for s in states}


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults put in by crc32(`conv_id:turn`) % 20, a null being one space:
    0 drops a row, 1 empties its text, 2 removes its `[.!?]`, 3 repeats it, 4 sets role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    text = space("text")
    slim = rows.select("conv_id", "turn", space("role").alias("role"), text.alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("fate")).filter("fate <> 0")
    return slim.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"),
    ).drop("again")


def _shape(text: Column) -> Column:
    """What a text shows by itself: blank, truncated or neither."""
    trimmed = F.btrim(text, F.lit(ASCII_SPACE))
    return F.when(trimmed == "", BLANK).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), CUT).otherwise(FINE)


def _stream(df: DataFrame, keys: int, each: Callable, schema: str) -> DataFrame:
    """df's partitions are sorted by their first `keys` columns; each(key, rows) yields output rows for each run of one key."""
    struct = T.StructType.fromDDL(schema)
    names = [f.name for f in struct.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(struct)
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out, held = [], 0
        for key, run_of in groupby(rows, key=lambda r: r[:keys]):
            for row in each(key, (r[keys:] for r in run_of)):
                out.append(row)
                held += 64 + sum(len(x) for x in row if isinstance(x, str))
                if held > 1 << 22:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], arrow)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], arrow)

    return df.mapInArrow(run, schema)


_CONV, _SEGMENT = ["conv", "unknown"], ["conv", "unknown", "segment"]


def ordered(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) by conversation and turn: conv, unknown (a null conv_id, whose conv is 0), turn, role,
    text, copies (equal rows beyond the first), shape, at (rising in that order), segment.

    Null turns come first; rows of one turn are ordered by role and text; a null role or text is one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    slim = rows.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("unknown"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    key = [*_CONV, "turn", "role", "text"]
    once = slim.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("copies"))
    dealt = once.withColumn("shape", _shape(F.col("text"))).repartitionByRange(*key).sortWithinPartitions(*key)
    # a row's number rises within a range, and from one range to the next
    return written(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("segment", F.shiftright("at", 33)), "structure-rows")


def faults(placed: DataFrame) -> DataFrame:
    """Of rows as `ordered` gives them: conv, unknown, segment, at, turn, initial, fault, copies. The initial of an empty role is one space."""
    firsts = placed.groupBy(*_CONV, "role", F.sha2("text", 256).alias("digest")).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    # numbers are unique, so this join has no hot key
    slim = placed.select(*_SEGMENT, "at", "turn", F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1)).alias("initial"), "shape", "copies").join(firsts, "at", "left")
    fault = F.when(F.col("shape") == BLANK, BLANK).when(F.col("first").isNull(), DUPLICATE).otherwise(F.col("shape"))
    return written(slim.select(*_SEGMENT, "at", "turn", "initial", fault.alias("fault"), "copies"), "structure-faults")


def _segment(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """One segment: its matrix by columns, and what it counts."""
    kinds, counts, initials, turns = [], dict.fromkeys((BLANK, DUPLICATE, CUT, FINE), 0), [], []
    illegal = distinct = 0
    for _, turn, initial, fault, copies in rows:
        kinds.append(((initial, fault), copies))
        counts[fault] += 1
        counts[BLANK if fault == BLANK else DUPLICATE] += copies
        illegal += copies + bool(initials and initials[1] + initial not in LEGAL_PAIRS)
        initials = [initials[0] if initials else initial, initial]
        if turn is not None:
            distinct += not turns or turns[1] != turn
            turns = [turns[0] if turns else turn, turn]
    matrix = [c for t in range(4) for c in vector_before(kinds, tuple(0 if s == t else FAR for s in range(4)))]
    yield (*key, matrix, counts[BLANK], counts[DUPLICATE], counts[CUT], illegal, *initials, distinct, *(turns or (None, None)))


def _conversation(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """A conversation's segments, last first: the costs behind each and whether it is the last; the first has the conversation's counts."""
    vector, after, sums, distinct, low, high, held = END, None, [0] * 4, 0, None, None, None
    for segment, matrix, *counts, first, last, turns, min_turn, max_turn in rows:
        if held:
            yield (*key, *held, False, *[None] * 6)
        held = (segment, list(vector), after is None)
        sums = [a + b for a, b in zip(sums, counts, strict=True)]
        sums[3] += after is not None and last + after not in LEGAL_PAIRS
        after = first
        if min_turn is not None:
            distinct += turns - (max_turn == low)
            low, high = min_turn, max_turn if high is None else high
        vector = tuple(min(FAR, *(matrix[4 * t + s] + vector[t] for t in range(4))) for s in range(4))
    yield (*key, *held, True, 0 if low is None else high - low + 1 - distinct, *sums, vector[START])


def _walks(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """A segment's walks, one for each state that it may be entered in. Its first row brings the costs behind it."""
    _, _, _, _, behind, last, first = next(rows)
    kinds = [((initial, fault), copies) for _, initial, fault, copies, *_ in rows]
    for entered, (left, audit) in walk(kinds, tuple(behind), (START,) if first else tuple(range(4))).items():
        yield (*key, entered, left, audit + (_tail(left) if last else ""))


def _linked(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Of each segment of a conversation, the walk from the state that the one before it ends in."""
    state = START
    for segment, walks in groupby(rows, key=lambda r: r[0]):
        _, entered, left, audit = next(w for w in walks if w[1] == state)
        yield (*key, segment, entered, audit)
        state = left


def _repaired(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """The rows of a segment after its edits. Its first row brings the state before it and the edits."""
    _, _, _, _, state, audit = next(rows)
    letters, at, nth = iter(audit), -1, 0
    for at, role, text, copies, *_ in rows:
        nth = 0
        while (letter := next(letters)) == "I":
            state = _NEXT[state]
            yield (*key, at, nth, letter, ROLE_OF[state], "")
            nth += 1
        if letter == "R":
            state = _NEXT[state]
            yield (*key, at, nth, letter, ROLE_OF[state], text)
        elif letter == "K":
            state = _AFTER[role[:1]][state]
            yield (*key, at, nth, letter, role, text)
        nth += 1
        for _ in range(copies):
            next(letters)
    for letter in letters:
        state = _NEXT[state]
        yield (*key, at, nth, letter, ROLE_OF[state], "")
        nth += 1


def _behind_first(rows: DataFrame, control: DataFrame) -> DataFrame:
    """rows of segments, each segment behind its one row of control, by number."""
    both = control.withColumn("at", F.lit(-1).cast("long")).unionByName(rows, allowMissingColumns=True)
    names = [*rows.columns, *[c for c in control.columns if c not in rows.columns]]
    return both.select(names).repartition(*_SEGMENT).sortWithinPartitions(*_SEGMENT, "at")


_KEYS = "conv long, unknown boolean"


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (conv_id, turn, role, text; other columns are not read) repaired at least cost. Three tables, each with conv and unknown:

    * conversations: gaps, blank, duplicate, truncated, illegal, cost;
    * audits, a row a segment: segment, entered, audit (initials of its edits);
    * repaired: the rows that stay or are inserted, in order of (at, nth), with edit, role and text.

    Conversations without rows are in none of them.
    """
    placed = ordered(rows)
    found = faults(placed)
    segments = _stream(
        found.repartition(*_SEGMENT).sortWithinPartitions(*_SEGMENT, "at"), 3, _segment,
        f"{_KEYS}, segment long, matrix array<long>, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, turns long, min_turn long, max_turn long",
    )
    behind = written(
        _stream(
            segments.repartition(*_CONV).sortWithinPartitions(*_CONV, F.col("segment").desc()), 2, _conversation,
            f"{_KEYS}, segment long, behind array<long>, last boolean, first boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long",
        ), "structure-segments",
    )
    walks = _stream(_behind_first(found.drop("turn"), behind.select(*_SEGMENT, "behind", "last", "first")), 3, _walks, f"{_KEYS}, segment long, entered long, left long, audit string")
    audits = written(_stream(walks.repartition(*_CONV).sortWithinPartitions(*_SEGMENT), 2, _linked, f"{_KEYS}, segment long, entered long, audit string"), "structure-audits")
    texts = placed.select(*_SEGMENT, "at", "role", "text", "copies")
    repaired = _stream(_behind_first(texts, audits.select(*_SEGMENT, "entered", "audit")), 3, _repaired, f"{_KEYS}, segment long, at long, nth long, edit string, role string, text string")
    conversations = behind.filter("first").select(*_CONV, "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return conversations, audits, repaired


def _digest(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    sha = hashlib.sha256()
    for i, (_, _, role, text) in enumerate(rows):
        sha.update(f"{chr(10) if i else ''}{role}:{text}".encode())
    yield (*key, sha.hexdigest())


def _joined(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    yield (*key, "".join(audit for _, audit in rows))


def summary(conv_ids: DataFrame, conversations: DataFrame, audits: DataFrame, repaired: DataFrame) -> DataFrame:
    """One row for each of conv_ids (conv_id; repeats and null allowed): its counts, cost, audit and the SHA-256 of its
    repaired `role:text` lines. A conversation without rows has zeros, an empty audit and the digest of nothing."""
    keys = conv_ids.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("unknown")).distinct()
    in_order = repaired.select(*_CONV, "at", "nth", "role", "text").repartition(*_CONV).sortWithinPartitions(*_CONV, "at", "nth")
    digests = _stream(in_order, 2, _digest, f"{_KEYS}, repaired_sha256 string")
    whole = _stream(audits.select(*_CONV, "segment", "audit").repartition(*_CONV).sortWithinPartitions(*_SEGMENT), 2, _joined, f"{_KEYS}, audit string")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    joined = keys.join(conversations, _CONV, "left").join(whole, _CONV, "left").join(digests, _CONV, "left")
    return joined.select(
        F.when(~F.col("unknown"), F.col("conv")).alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
