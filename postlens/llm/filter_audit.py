"""Filter interaction audit by count-weighted decision diagrams.

Each document gets a mask of the filters that it fails, whatever their order. Per part the counts of each
mask (at most 2**k rows for k filters) become a decision diagram: one level a filter, a node's edges lead
to the documents that pass and to those that fail, and each node holds the counts of what reaches it.
Swapping two neighbouring levels only regroups the grandchildren of the upper one, so all k! orders are
met by k! - 1 swaps. In an order's diagram the path of passes from the root is the run of its filters:
what goes on is kept, the failing edge is removed.

Documents are counted by partial sums, so a hot part is no large group; a part's diagram has at most
2**(k+1) nodes, however many documents it stands for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, text_or_empty, written

_SPACES = r"[\x20\x09-\x0D]+"
#: What is counted of the documents that reach a node.
N, GOOD, TOXIC = range(3)


class Diagram:
    """A quasi-reduced decision diagram over `order`; leaves are vectors of counts, equal nodes are shared.

    self.levels[i] maps a node's number to its (pass, fail) children on level i + 1; the last level is the leaves.
    """

    def __init__(self, order: str, counts: dict[int, np.ndarray], bits: dict[str, int]):
        self.order, self.weight, self._next = list(order), {}, 0
        self.levels: list[dict[int, tuple[int, int]]] = [{} for _ in order]
        self._leaves: dict[bytes, int] = {}
        self._known: list[dict[tuple[int, int], int]] = [{} for _ in order]
        width = len(next(iter(counts.values())))

        def build(level: int, mask: int) -> int:
            if level == len(order):
                return self._leaf(counts.get(mask, np.zeros(width, np.int64)))
            bit = bits[order[level]]
            return self._node(level, build(level + 1, mask), build(level + 1, mask | bit))

        self.root = build(0, 0)

    def _leaf(self, counts: np.ndarray) -> int:
        key = counts.tobytes()
        if key not in self._leaves:
            self._leaves[key] = self._next
            self.weight[self._next] = counts
            self._next += 1
        return self._leaves[key]

    def _node(self, level: int, passed: int, failed: int) -> int:
        known = self._known[level]
        if (passed, failed) not in known:
            known[passed, failed] = self._next
            self.levels[level][self._next] = (passed, failed)
            self.weight[self._next] = self.weight[passed] + self.weight[failed]
            self._next += 1
        return known[passed, failed]

    def swap(self, level: int) -> None:
        """Swaps the filters of level and level + 1. Nodes above and below are not touched: a node of the upper
        level keeps its number and its counts, only its children are made anew."""
        upper, lower = self.levels[level], self.levels[level + 1]
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]
        self.levels[level + 1], self._known[level + 1] = {}, {}
        for node, (passed, failed) in upper.items():
            (pp, pf), (fp, ff) = lower[passed], lower[failed]
            upper[node] = (self._node(level + 1, pp, fp), self._node(level + 1, pf, ff))
        self._known[level] = {children: node for node, children in upper.items()}
        for node in lower.keys() - self.levels[level + 1].keys():
            del self.weight[node]

    def steps(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """Along the path of passes: filter, counts kept after it, counts removed by it."""
        node = self.root
        for level, letter in enumerate(self.order):
            node, failed = self.levels[level][node]
            yield letter, self.weight[node], self.weight[failed]


def swaps(n: int) -> Iterator[int]:
    """Places of the neighbours to swap, one after the other, to pass through all orders of n things."""
    order, facing = list(range(n)), [-1] * n
    while True:
        movable = [x for x in order if 0 <= (at := order.index(x)) + facing[x] < n and order[at + facing[x]] < x]
        if not movable:
            return
        x = max(movable)
        at = order.index(x)
        to = at + facing[x]
        order[at], order[to] = order[to], order[at]
        yield min(at, to)
        for y in range(x + 1, n):
            facing[y] = -facing[y]


COLUMNS = ["filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(letters: str, counts: dict[int, np.ndarray]) -> list[tuple]:
    """Rows of COLUMNS for one part: all orders of letters, from its counts by mask (bit i: the i-th filter fails)."""
    bits = {x: 1 << i for i, x in enumerate(letters)}
    diagram = Diagram(letters, counts, bits)
    fails = {x: sum(int(c[N]) for mask, c in counts.items() if mask & bits[x]) for x in letters}
    rows, shapley, alone = [], dict.fromkeys(letters, 0), {}

    def read() -> None:
        order = "".join(diagram.order)
        for step, (x, kept, removed) in enumerate(diagram.steps(), 1):
            shapley[x] += int(removed[N])
            if step == len(letters):
                alone[x] = int(removed[N])  # what the last filter removes fails nothing else
            rows.append((order, step, x, int(kept[N]), int(removed[N]), fails[x] - int(removed[N]), int(removed[GOOD]), int(removed[TOXIC])))

    read()
    for level in swaps(len(letters)):
        diagram.swap(level)
        read()
    return [(*r[:6], alone[r[2]], *r[6:], shapley[r[2]]) for r in rows]


def five_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text shows by itself; E, a repeated text, is a matter of the table."""
    trimmed = F.btrim(text, F.lit(ASCII_SPACE))
    words = F.filter(F.split(trimmed, _SPACES), lambda w: w != "")
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": capitals * 100 > F.char_length(text) * 3,
        "D": text.rlike("[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, labels: DataFrame, failures=five_failures) -> tuple[str, DataFrame]:
    """The filters' letters and a row per document: part, mask, good, toxic (booleans).

    part is lang, a null one the empty string; a null text is empty. The last filter after those of `failures`
    is E: the text is identical (same SHA-256 digest of its bytes) to that of a smaller doc_id of the table; a
    null doc_id has no smaller one and is none. An id with several labels counts as good or toxic if one says so.
    """
    checks = failures(F.col("text"))
    letters = "".join(checks) + "E"
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_or_empty().alias("text"))
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(checks.values())), F.lit(0))
    # texts go no further than this
    slim = written(slim.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask")), "audit-masks")
    firsts = written(slim.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "audit-firsts")
    marks = written(
        labels.groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")).filter("good or toxic"),
        "audit-labels",
    )
    repeated = F.when(F.col("doc_id") > F.col("first_id"), F.lit(1 << len(checks))).otherwise(F.lit(0))
    no = F.lit(False)
    rows = slim.join(firsts, "digest", "left").join(marks, "doc_id", "left")
    return letters, rows.select("part", (F.col("mask") + repeated).alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def audit(letters: str, masks: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: what the step keeps and removes, from rows (part, mask, good, toxic).

    An empty table has no parts and gives no rows; a part has all k! * k rows, zeros included.
    """
    one = lambda c: F.sum(F.col(c).cast("long"))
    counts = masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), one("good").alias("good"), one("toxic").alias("toxic"))
    # at most 2**k entries a part
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = audited(letters, {c["mask"]: np.array([c["n"], c["good"], c["toxic"]], np.int64) for c in counts})
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows)), *(pa.array(c) for c in zip(*rows, strict=True))], ["part", *COLUMNS])

    schema = "part string, filter_order string, step long, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return parts.mapInArrow(run, schema).withColumn("step", F.col("step").cast("int"))
