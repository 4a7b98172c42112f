"""Line deduplication within an edit distance, by a segment-partition join.

A line goes if an equal line, or a near one, comes before it in the order of (doc_id, line number). Two
lines are near within `edits` edits (insert, delete, substitute one code point), and within one edit for
every `chars_per_edit` characters of the shorter one: by default 1 edit from 10 characters on, 2 from 20.
Lines of fewer characters are compared for equality alone, as one edit makes another line of them.

Equal lines collapse to one by a 128-bit hash and get a number. Distinct lines are then cut into edits + 1
segments: within that many edits one segment stays whole. Each line posts its segments under its length and
probes, for its own length and the shorter ones in question, the substrings that can be such a segment.
Pairs that meet in a posting are verified by a banded bit-parallel edit distance. Lines that may have one
edit post two segments, longer ones three; a line at the border does both.

A posting with more than `list_cap` lines emits only pairs of near signatures (parities of classes of characters
and of neighbours, of which an edit turns few), one of more than SIGNED times as many none at all. Its lines are narrowed down, see `_narrow`:
the stretch of a line that may differ is halved until the postings are short or nothing is left of it. In the
latter all lines of a posting are near, and each is linked to the first one alone. So no list is paired whole
and no line is left out. Blank lines stay. Null texts have no lines but one empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, unused, written

EDITS, CHARS_PER_EDIT, LIST_CAP = 2, 10, 20
#: A list of up to so many times LIST_CAP lines emits the pairs whose signatures are near.
SIGNED = 10
#: Up to so many lines in question, some 90 bytes each, are broadcast.
BROADCAST_HASHES = 1_000_000


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line, a, b: a and b are 128 bits of hash."""
    cut = docs.select("doc_id", F.posexplode(F.split(text_or_empty(), "\n", -1)).alias("line_no", "line"))
    return cut.filter(F.col("line").rlike(r"[^ \t\x0b\x0c\r]")).withColumns({"a": F.xxhash64("line"), "b": F.xxhash64(F.lit("line"), "line")})


def _wide(line: Column) -> Column:
    """Four bytes a code point, so that a stretch is cut out without counting from the line's start."""
    return F.encode(line, "UTF-32")


def _cut(wide: Column, at: Column, size: Column) -> Column:
    """`size` code points from `at` (from 1) on."""
    return F.substring(wide, at * 4 - 3, size * 4)


def _chars(wide: Column) -> Column:
    return F.shiftright(F.octet_length(wide), 2)


def within_edits(edits: int, allowed: Column) -> Column:
    """Whether the columns x and y (arrays of characters) are within allowed <= edits edits, by bits along diagonals.

    State d holds a bit for each diagonal -edits..edits that d edits or fewer reach. A character of b keeps the
    diagonals on which it equals a's (match), passes those of d - 1 on (substitute), one lower (insert)
    and, after it, one higher (delete).
    """
    full = (1 << (2 * edits + 1)) - 1

    def deleted(states: list[Column]) -> list[Column]:
        out = [states[0]]
        for s in states[1:]:
            out.append(s.bitwiseOR(F.shiftleft(out[-1], 1)).bitwiseAND(F.lit(full)))
        return out

    def pack(states: list[Column]) -> Column:
        return F.struct(*[s.cast("int").alias(f"s{d}") for d, s in enumerate(states)])

    def step(acc: Column, j: Column) -> Column:
        same = None
        for o in range(-edits, edits + 1):
            hit = F.when(F.get("x", j + o) == F.get("y", j), F.lit(1 << (o + edits))).otherwise(F.lit(0))
            same = hit if same is None else same.bitwiseOR(hit)
        old = [acc[f"s{d}"] for d in range(edits + 1)]
        new = [old[0].bitwiseAND(same)]
        for d in range(1, edits + 1):
            new.append(old[d].bitwiseAND(same).bitwiseOR(old[d - 1]).bitwiseOR(F.shiftright(old[d - 1], 1)))
        return pack(deleted(new))

    start = deleted([F.lit(1 << edits)] * (edits + 1))
    n, m = F.size("x"), F.size("y")
    last = F.when(m > 0, F.aggregate(F.sequence(F.lit(0), m - 1), pack(start), step)).otherwise(pack(start))
    state = reduce(lambda acc, d: acc.when(allowed == d, last[f"s{d}"]), range(edits + 1), F)
    reached = F.call_function("shiftright", state, (n - m + edits).cast("int")).bitwiseAND(F.lit(1)) == 1
    return F.when(F.abs(n - m) <= allowed, reached).otherwise(F.lit(False))


def _common(u: Column, v: Column, part, most: Column) -> Column:
    """Length of the longest common start (part F.left) or end (F.right) of at most `most` characters, by halving steps."""

    def longer(acc: Column, step: Column) -> Column:
        at = acc + step
        return F.when((at <= most) & (part(u, at) == part(v, at)), at).otherwise(acc)

    return F.aggregate(F.array(*[F.lit(1 << i) for i in range(29, -1, -1)]), F.lit(0), longer)


def _characters(pairs: DataFrame) -> DataFrame:
    """x and y: what differs of u_line and v_line, as arrays of characters, without their common start and end.

    Such rests differ at both ends. So one edit allows rests of one character at most, and two edits are at the
    two ends if a rest is longer than two: its middle half then stands in the other rest, shifted by one place at most.
    Pairs without that are left out before any character is looked at.
    """
    # each step is a table: a filter moved below a projection would compute it anew for every character
    u, v = F.col("u_line"), F.col("v_line")
    cut = written(pairs.withColumn("head", _common(u, v, F.left, F.least(F.length(u), F.length(v)))), "line-heads")
    cut = written(cut.select("u", "v", "allowed", *[F.right(F.col(f"{c}_line"), F.length(f"{c}_line") - F.col("head")).alias(f"{c}_rest") for c in "uv"]), "line-rests")
    ru, rv = F.col("u_rest"), F.col("v_rest")
    cut = written(cut.withColumn("tail", _common(ru, rv, F.right, F.least(F.length(ru), F.length(rv)))), "line-tails")
    cut = written(cut.select("u", "v", "allowed", *[F.left(F.col(f"{c}_rest"), F.length(f"{c}_rest") - F.col("tail")).alias(f"{c}_rest") for c in "uv"]), "line-cores")
    n, m = F.length("u_rest"), F.length("v_rest")
    half, quarter = F.shiftright(n, 1), F.shiftright(n, 2)
    middle = F.col("v_rest").substr(quarter, half + 2).contains(F.col("u_rest").substr(quarter + 1, half))
    may = (F.abs(n - m) <= F.col("allowed")) & ((F.greatest(n, m) <= F.col("allowed")) | ((F.col("allowed") == 2) & ((F.least(n, m) <= 6) | middle)))
    chars = lambda c: F.filter(F.split(c, ""), lambda ch: ch != "")
    return written(cut.filter(may).select("u", "v", "allowed", chars("u_rest").alias("x"), chars("v_rest").alias("y")), "line-characters")


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i of a line."""
    # floor(length * i / parts) cuts evenly, whole numbers only
    at = lambda k: F.call_function("div", length * k, F.lit(parts)).cast("int")
    return at(i), at(i + 1) - at(i)


def _postings(wide: Column, edits: int) -> list[Column]:
    """A line's segments and its probes of lines that are shorter by up to `edits`, or shifted: hashes, of which the last bit says whether it is an own
    segment, and the three before it which scheme and length it is of."""
    parts, keys, n = edits + 1, [], _chars(wide)
    for less in range(edits + 1):
        length = n - less
        for i in range(parts):
            start, size = _segment(length, i, parts)
            # both views of the edits: those before the segment and those behind it bound its shift
            low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
            for shift in range(low, high + 1):
                # inside the line always, as each segment has a character or more
                key = F.xxhash64(F.lit(edits), length, F.lit(i), _cut(wide, start + shift + 1, size))
                keys.append(key.bitwiseAND(F.lit(-16)).bitwiseOR(F.lit(8 * (edits - 1) + 2 * less + int(less == 0 and shift == 0))))
    return keys


def _posted(lines: DataFrame, edits: int, chars: int) -> DataFrame:
    """lines with `posts` in place of `wide`: the postings of each line, one scheme for each number of edits that a pair with it may have.

    A pair's edits go by its shorter line. With two edits at most, the scheme of one serves lines of chars to
    2 * chars characters, and that of two those from 2 * chars on.
    """
    n, wide = _chars(F.col("wide")), F.col("wide")
    kept = [c for c in lines.columns if c != "wide"]
    fit = {1: (n >= chars) & (n <= 2 * chars) if edits == 2 else n >= chars, 2: n >= 2 * chars}
    schemes = range(1, edits + 1)
    # step by step: a choice around the hashes would make one method of them, too long to be compiled
    each = lines.select(*kept, *[F.when(fit[e], wide).alias(f"w{e}") for e in schemes])
    each = each.select(*kept, *[f"w{e}" for e in schemes], *[F.array(*_postings(F.col(f"w{e}"), e)).alias(f"p{e}") for e in schemes])
    posts = F.when(F.col("w1").isNotNull(), F.col("p1"))
    if edits == 2:
        posts = F.when(F.col("w1").isNull() & F.col("w2").isNotNull(), F.col("p2")).when(F.col("w2").isNotNull(), F.concat("p1", "p2")).when(F.col("w1").isNotNull(), F.col("p1"))
    return each.select(*kept, posts.alias("posts"))


def _listed(posts: DataFrame) -> DataFrame:
    """posts and n, the size of its list, of lists with two entries and an own one at least."""
    # one sum for both counts: entries below, own ones above 2**40
    count = F.sum(F.lit(1).cast("long") + F.when(F.col("own"), F.lit(1 << 40)).otherwise(F.lit(0))).alias("sum")
    sizes = posts.groupBy("key").agg(count).withColumn("n", F.col("sum").bitwiseAND(F.lit((1 << 40) - 1))).filter((F.col("n") > 1) & (F.col("sum") >= F.lit(1 << 40)))
    # merged at any size: a side that is broadcast while it is small would hide what the shuffle takes at scale
    return posts.join(written(sizes.select("key", "n"), "line-lists").hint("merge"), "key")


def _met(listed: DataFrame, signed: int = 0) -> DataFrame:
    """Pairs u < v of lines that meet in a posting; with `signed`, those whose signatures allow for so many edits."""
    sig = ["ones", "twos"] if signed else []
    left = listed.filter("own").select("key", F.col("id").alias("u"), *sig)
    right = listed.select("key", F.col("id").alias("v"), "own", *[F.col(c).alias(f"v_{c}") for c in sig])
    close = f" and bit_count(ones ^ v_ones) <= {2 * signed} and bit_count(twos ^ v_twos) <= {4 * signed}" if signed else ""
    pairs = left.join(right, (left["key"] == right["key"]) & F.expr(f"u <> v and (u < v or not own){close}"))
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _signature(line: Column) -> Column:
    """ones, twos: 64 parities each, whether the characters, or the pairs of neighbours, of a class occur an odd number of times.

    An edit turns two bits of the first at most, and four of the second.
    """
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n.bitwiseAND(F.lit(63)))
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("ones"), F.lit(0).cast("long").alias("twos"))

    def step(acc: Column, c: Column) -> Column:
        twos = F.when(acc["last"] < 0, acc["twos"]).otherwise(acc["twos"].bitwiseXOR(bit(acc["last"] * 37 + F.ascii(c))))
        return F.struct(F.ascii(c).alias("last"), acc["ones"].bitwiseXOR(bit(F.ascii(c))).alias("ones"), twos.alias("twos"))

    return F.aggregate(F.filter(F.split(line, ""), lambda c: c != ""), start, step)


def _window(p: Column, n: Column, w: Column, tag: str, line: Column) -> Column:
    """The ways to narrow a stretch that holds one edit: array of (fixed, p, n, w).

    The stretch has n characters from p on; in the shorter line of the pair it has w. One of the halves of
    those w stays whole, at the stretch's start or end, and is fixed (hashed) now. Of one character either
    it is the edit, or it stays whole before or behind an inserted one. With w = 0 the stretch is settled.
    """
    half = F.shiftright(w, 1)
    fixed = lambda kind, at, size: F.xxhash64(F.lit(tag + kind), _cut(line, at, size))
    way = lambda key, p, n, w: F.struct(key.alias("fixed"), p.cast("int").alias("p"), n.cast("int").alias("n"), w.cast("int").alias("w"))
    halves = F.array(way(fixed("front", p, half), p + half, n - half, w - half), way(fixed("back", p + n - (w - half), w - half), p, n - (w - half), half))
    single = F.filter(
        F.array(
            F.when(n <= 1, way(F.xxhash64(F.lit(tag + "any")), p, F.lit(0), F.lit(0))),
            F.when(n >= 1, way(fixed("first", p, F.lit(1)), p + 1, n - 1, F.lit(0))),
            F.when(n >= 1, way(fixed("last", p + n - 1, F.lit(1)), p, n - 1, F.lit(0))),
        ),
        lambda x: x.isNotNull(),
    )
    return F.when(w >= 2, halves).when(w == 1, single).otherwise(F.array(way(F.xxhash64(F.lit(tag)), p, n, w)))


def _pair_window(p: Column, n: Column, w: Column, own: Column, line: Column) -> Column:
    """The ways to narrow a stretch that holds two edits: array of (fixed, own, e1, p1, n1, w1, p2, n2, w2).

    Both edits lie in one half, or one in each; then the front half may be longer or shorter by one character.
    Of w <= 1 characters, up to two stretch characters are two edits at most; of three one must be the own one.
    """
    half, less = F.shiftright(w, 1), n - w
    fixed = lambda kind, at, size: F.xxhash64(F.lit(kind), _cut(line, at, size))
    no = F.lit(0)

    def way(key, owns, e1, p1, n1, w1, p2=no, n2=no, w2=no):
        parts = {"p1": p1, "n1": n1, "w1": w1, "p2": p2, "n2": n2, "w2": w2}
        return F.struct(key.alias("fixed"), owns.alias("own"), F.lit(e1).alias("e1"), *[c.cast("int").alias(k) for k, c in parts.items()])

    ways = [
        way(fixed("2front", p, half), own, 2, p + half, n - half, w - half), way(fixed("2back", p + n - (w - half), w - half), own, 2, p, n - (w - half), half),
        # the lengths say which shifts are left: each half differs by one character at most
        *[F.when(F.abs(less - s) <= 1, way(F.xxhash64(F.lit("each")), own & F.lit(s == 0), 1, p, half + s, half, p + half + s, n - half - s, w - half)) for s in (-1, 0, 1)],
    ]
    few = [F.when(n <= 2, way(F.xxhash64(F.lit("2any")), own, 1, p, no, no))]
    few += [F.when((w == 1) & ((n == 1) | (n == 3)) & (F.lit(i) < n), way(fixed(f"2at{i}", p + i, F.lit(1)), own, 1, p, no, no)) for i in range(3)]
    few += [F.when((w == 1) & (n == 1), way(fixed(f"2at{i}", p, F.lit(1)), own, 1, p, no, no)) for i in (1, 2)]
    some = lambda ways: F.filter(F.array(*ways), lambda x: x.isNotNull())
    return F.when(w >= 2, some(ways)).otherwise(some(few))


def _narrowed(states: DataFrame, text: DataFrame) -> DataFrame:
    """states: key, id, own, e1 (edits in stretch 1), p1, n1, w1, p2, n2, w2; text: id, wide. The states one step narrower, under new keys."""
    at = states.join(text.select("id", "wide"), "id")
    two = at.filter("e1 = 2").select("key", "id", "wide", F.explode(_pair_window(*map(F.col, ("p1", "n1", "w1", "own", "wide")))).alias("x"))
    two = two.select(F.xxhash64("key", "x.fixed").alias("key"), "id", *[f"x.{c}" for c in ("own", "e1", "p1", "n1", "w1", "p2", "n2", "w2")], "wide")
    # one edit in each half fixes nothing yet, so the longer half is halved at once
    apart = two.filter("e1 = 1 and (w1 > 0 or w2 > 0)")
    one = at.filter("e1 = 1").select(apart.columns).unionByName(apart)
    # of two stretches the longer one: a state gives two rows a step, and most of them have no partner any more
    first = F.col("w1") >= F.col("w2")
    ways = [_window(*map(F.col, (f"p{k}", f"n{k}", f"w{k}")), str(k), F.col("wide")) for k in (1, 2)]
    one = one.withColumn("x", F.explode(F.when(first, ways[0]).otherwise(ways[1])))
    stretch = lambda c, k: F.when(first if k == 1 else ~first, F.col(f"x.{c}")).otherwise(F.col(f"{c}{k}")).alias(f"{c}{k}")
    one = one.select(F.xxhash64("key", "x.fixed").alias("key"), "id", "own", "e1", *[stretch(c, k) for k in (1, 2) for c in ("p", "n", "w")])
    return one.unionByName(two.filter("e1 = 2 or (w1 = 0 and w2 = 0)").drop("wide"))


def _narrow(crowd: DataFrame, text: DataFrame, edits: int, chars: int, list_cap: int) -> tuple[DataFrame, DataFrame]:
    """crowd: id and kind (scheme, and how much shorter the other line is) of the entries of long postings; text: id, rank (the order of first lines), wide, ones and twos (its signature).

    Returns pairs u, v still to verify, and links u, v to the first line of settled lists, whose lines are all
    near. A state says where in a line the edits may lie: one stretch with both, or two with one each; all that
    was found outside is hashed into the key. Lists over the cap go on with halved stretches, so a list that
    stays long costs a few rows a line and step, and the steps are the logarithm of a line's length.
    """
    n, zero = _chars(F.col("wide")), F.lit(0)
    own, starts = text.join(crowd, "id"), []
    for e in range(1, edits + 1):
        fit = own.filter((F.shiftright("kind", 2) == e - 1) & (n >= e * chars) & (F.lit(True) if e == edits else n < (e + 1) * chars + e))
        state = fit.select("id", n.alias("n1"), (n - F.col("kind").bitwiseAND(F.lit(3))).alias("w1"))
        # of two lines in e edits the shorter has e * chars characters or more
        state = state.filter(F.col("w1") >= e * chars)
        starts.append(state.select(F.xxhash64(F.lit(e), "w1").alias("key"), "id", (F.col("n1") == F.col("w1")).alias("own"), F.lit(e).alias("e1"), F.lit(1).alias("p1"), "n1", "w1", zero.alias("p2"), zero.alias("n2"), zero.alias("w2")))
    states = written(_narrowed(reduce(DataFrame.unionByName, starts), text), "line-states")
    pairs, links = [], []
    while True:
        listed = written(_listed(states), "line-stretches")
        settled = (F.col("e1") == 1) & (F.col("w1") == 0) & (F.col("w2") == 0)
        done = listed.filter(settled).select("key", "id").join(text.select("id", "rank"), "id")
        first = written(done.groupBy("key").agg(F.min_by("id", "rank").alias("v")), "line-least")
        links.append(written(done.join(first, "key").filter("id <> v").select(F.col("id").alias("u"), "v").distinct(), "line-stars"))
        short = listed.filter(~settled & (F.col("n") <= list_cap)).join(text.select("id", "ones", "twos"), "id")
        pairs.append(written(_met(short, edits), "line-narrow-pairs"))
        long = listed.filter(~settled & (F.col("n") > list_cap)).drop("n")
        if long.isEmpty():
            return reduce(DataFrame.unionByName, pairs).distinct(), reduce(DataFrame.unionByName, links).distinct()
        # a line may reach a list in several ways that mean the same
        states = written(_narrowed(long.distinct(), text), "line-states")


def near_pairs(posts: DataFrame, lines: DataFrame, distinct: DataFrame, edits: int = EDITS, chars_per_edit: int = CHARS_PER_EDIT, list_cap: int = LIST_CAP) -> DataFrame:
    """posts: key, id, own, kind of distinct lines; lines: a, b, line, repeats allowed; distinct: id, a, b, rank.

    Returns u, v: near lines, all pairs but those that a link of each to the first line near both stands for.
    """
    listed = written(_listed(posts), "line-listed")
    found = written(_met(listed.filter(F.col("n") <= list_cap)), "line-pairs")
    crowd = written(listed.filter(F.col("n") > list_cap).select("key", "id", "own", "kind", "n"), "line-crowd")
    # the texts of the lines in question alone, fetched once
    asked = found.select(F.col("u").alias("id")).unionByName(found.select(F.col("v").alias("id"))).unionByName(crowd.select("id")).distinct()
    asked = written(distinct.join(asked, "id", "left_semi").select("id", "a", "b", "rank"), "line-asked")
    # up to the bound the hashes go to the lines; beyond it the lines go to the hashes
    sought = F.broadcast(asked) if asked.count() <= BROADCAST_HASHES else asked
    text = written(lines.join(sought, ["a", "b"]).select("id", "rank", "line").dropDuplicates(["id"]), "line-texts")
    # lines of long lists alone are signed
    signed = text.join(crowd.select("id").distinct(), "id", "left_semi")
    signed = written(signed.select("id", "rank", _wide(F.col("line")).alias("wide"), _signature(F.col("line")).alias("sig")).select("id", "rank", "wide", "sig.ones", "sig.twos"), "line-signed")
    wide_cap = list_cap * SIGNED
    middling = crowd.filter(F.col("n") <= wide_cap).join(signed.select("id", "ones", "twos"), "id")
    longest = written(crowd.filter(F.col("n") > wide_cap).select("id", "kind").distinct(), "line-longest")
    more, links = _narrow(longest, signed, edits, chars_per_edit, wide_cap)
    pairs = found.unionByName(_met(middling, edits)).unionByName(more).distinct()
    sides = pairs.join(text.select(F.col("id").alias("u"), F.col("line").alias("u_line")), "u").join(text.select(F.col("id").alias("v"), F.col("line").alias("v_line")), "v")
    allowed = F.call_function("div", F.least(F.length("u_line"), F.length("v_line")), F.lit(chars_per_edit))
    near = _characters(sides.withColumn("allowed", F.least(allowed, F.lit(edits)))).filter(within_edits(edits, F.col("allowed")))
    return near.select("u", "v").unionByName(links).distinct()


def dedup(docs: DataFrame, edits: int = EDITS, chars_per_edit: int = CHARS_PER_EDIT, list_cap: int = LIST_CAP) -> DataFrame:
    """One row per line that is not blank: doc_id, line_no, a, b, copy (an equal line comes before), near (a near one does).

    edits: 1 or 2. Columns of docs other than doc_id and text are not read; null ids come first in the order.
    Equal lines at one place of one id, in rows that repeat it, are one line: they stay or go together.
    """
    if edits not in (1, 2) or chars_per_edit < edits + 2:
        raise ValueError("edits must be 1 or 2, and chars_per_edit leave each segment a character")
    read = lines_of(docs)
    order = F.struct("doc_id", "line_no")
    lines = written(read.select("doc_id", "line_no", "a", "b"), "lines")
    posted = _posted(read.select("doc_id", "line_no", "a", "b", _wide(F.col("line")).alias("wide")), edits, chars_per_edit)
    firsts = posted.groupBy("a", "b").agg(F.min(order).alias("rank"), F.any_value("posts").alias("posts"))
    # of different lines at one place of one id the hashes decide
    firsts = firsts.withColumn("rank", F.struct("rank.doc_id", "rank.line_no", "a", "b"))
    distinct = written(firsts.withColumn("id", F.monotonically_increasing_id()), "line-distinct")
    # a line may post one key twice; its list is then a little longer
    posts = distinct.select("id", F.explode("posts").alias("post")).select(
        F.col("post").bitwiseAND(F.lit(-16)).alias("key"), "id", (F.col("post").bitwiseAND(F.lit(1)) == 1).alias("own"), F.shiftright(F.col("post").bitwiseAND(F.lit(15)), 1).cast("byte").alias("kind")
    )
    pairs = written(near_pairs(posts, read.filter(F.length("line") >= chars_per_edit).select("a", "b", "line"), distinct, edits, chars_per_edit, list_cap), "line-links")
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    ranks = distinct.select("id", "a", "b", "rank")
    earlier = both.join(ranks.select(F.col("id").alias("v"), F.col("rank").alias("other")), "v").groupBy("u").agg(F.min("other").alias("earlier"))
    known = ranks.join(earlier, ranks["id"] == earlier["u"], "left").select("a", "b", "rank", F.coalesce(F.col("earlier") < F.col("rank"), F.lit(False)).alias("near"))
    known = written(known, "line-classes")
    return lines.join(known, ["a", "b"]).select("doc_id", "line_no", "a", "b", (order != F.struct("rank.doc_id", "rank.line_no")).alias("copy"), "near")


def summary(docs: DataFrame, **how) -> DataFrame:
    """One row per doc_id: doc_id, n_lines, n_copies, n_near (near but not a copy), n_kept; blank lines aren't counted.

    Rows that repeat a doc_id are summed. A document without such lines has zeros.
    """
    marked = dedup(docs, **how)
    counts = marked.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("copy").cast("long")).alias("n_copies"), F.sum((F.col("near") & ~F.col("copy")).cast("long")).alias("n_near")
    )
    ids = docs.select(F.col("doc_id").alias("_id")).distinct()
    whole = ids.join(counts, ids["_id"].eqNullSafe(counts["doc_id"]), "left").drop("doc_id").withColumnRenamed("_id", "doc_id").fillna(0, ["n_lines", "n_copies", "n_near"])
    return whole.withColumn("n_kept", F.col("n_lines") - F.col("n_copies") - F.col("n_near")).select("doc_id", "n_lines", "n_copies", "n_near", "n_kept")


def without_repeats(docs: DataFrame, **how) -> DataFrame:
    """docs with `kept_text` added, in place of a column of that name: the lines that stay, blank ones too, in order."""
    docs = docs.drop("kept_text")
    gone, name = unused(docs, "_gone", "_id")
    right = dedup(docs, **how).filter("copy or near").groupBy(F.col("doc_id").alias(name)).agg(F.collect_set("line_no").alias(gone))  # bounded by a text's lines
    kept = F.array_join(F.filter(F.split(text_or_empty(), "\n", -1), lambda line, i: ~F.array_contains(F.coalesce(gone, F.array().cast("array<int>")), i)), "\n")
    return docs.join(right, docs["doc_id"].eqNullSafe(right[name]), "left").withColumn("kept_text", kept).drop(name, gone)
