"""Deduplicating operators against brute force on small tables."""

import hashlib
import random

import xxhash
from postlens.llm import exact_dedup, line_dedup, simhash, similar, suffix_dedup

from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, kept string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "clash") for i, t in enumerate(texts)], SCHEMA).repartition(3)


def words(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def test_exact(spark):
    rows = [(0, "a b"), (1, "ab"), (2, None), (3, " \n"), (4, "ab "), (5, "a  b"), (5, "a  b"), (None, "z"), (7, "é"), (8, "x" * 100_000)]
    out = exact_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c for c in t or "" if c not in SPACE), []).append((-len(t or ""), i is None, i or 0))
    assert len(out) == len(rows)
    for norm, members in groups.items():
        got = [r for r in out if r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()]
        best = min(members)
        assert {r.keep_id for r in got} == {None if best[1] else best[2]} and {r.group_size for r in got} == {len(members)}
        assert sum(r.kept for r in got) == 1
    kept = exact_dedup.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, (r.doc_id for r in kept))) == sorted(map(str, (5, 3, None, 7, 8)))


def test_exact_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.dedup(none).count() == 0 and exact_dedup.keep_first(none).count() == 0


def test_exact_compares_bytes(spark):
    """With a digest of one hex digit most groups collide; the bytes part them."""
    rows = [(i, f"text {i % 40}" + " " * (i % 3)) for i in range(160)]
    out = exact_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest=lambda c: F.substring(F.md5(c), 1, 1)).collect()
    for r in out:
        same = [(-len(t), i) for i, t in rows if t.strip() == f"text {r.doc_id % 40}"]
        assert (r.keep_id, r.group_size, r.kept) == (min(same)[1], len(same), r.doc_id == min(same)[1])


def test_exact_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_HASHES", 0)
    out = exact_dedup.dedup(docs_of(spark, ["a", "b", "a ", None])).collect()
    assert {r.doc_id: r.keep_id for r in out} == {0: 2, 1: 1, 2: 2, 3: 3}


def test_exact_keeps_columns_of_any_name(spark):
    rows = [(1, "a b", "mine", 1, {"k": 1}), (2, "ab", "mine", 2, {}), (3, None, None, None, None), (3, "", "b", 3, {}), (3, "", "a", 3, {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `_name` string, `_rank` int, `a b.c` map<string,int>").withColumn("_digest", F.lit("d"))
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id, r.text, r["_name"], r["_rank"], r["a b.c"], r["_digest"]) for r in kept.collect() if r.doc_id == 1)
    assert got == [(1, "a b", "mine", 1, {"k": 1}, "d")] and sum(r.doc_id == 3 for r in kept.collect()) == 1


def simhash_of(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(fps, bits=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash(spark):
    rnd = random.Random(5)
    base = [words(rnd, 150) for _ in range(20)]
    texts = [*base, None, "", " \t", "One", "one", "one two", "É é", base[0].upper()]
    for t in base[:12]:
        w = t.split()
        for _ in range(6):
            w[rnd.randrange(len(w))] = "new"
            texts.append(" ".join(w))
    fps = [simhash_of(t) for t in texts]
    expected = roots(fps)
    for cap in (200, 2):  # all lists, then nearly all by variants
        out = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, texts), list_cap=cap).collect()}
        assert [out[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
        assert [out[i].component_id for i in range(len(texts))] == expected
    kept = simhash.keep_one(docs_of(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected)) and kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


def test_simhash_links_of_dense_codes(spark):
    rnd = random.Random(6)
    fps = sorted({rnd.getrandbits(64) for _ in range(20)} | {0b1011 ^ 1 << i ^ 1 << j for i in range(12) for j in range(12)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    for cap in (10_000, 3):
        from postlens.llm.graph import components

        got = {r.node: r.root for r in components(simhash.links(nodes, list_cap=cap)).collect()}
        comps = {}
        for f, r in zip(signed, roots(fps), strict=True):
            comps.setdefault(r, set()).add(f)
        for members in comps.values():
            assert len({got.get(m, m) for m in members}) == 1


def test_keep_dissimilar_hub(spark):
    """Copies that are alike to their original only are found through it."""
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(120):
        copy = list(words)
        for at in rnd.sample(range(80), 6):
            copy[at * 5] = f"x{i}_{at}"
        texts.append(" ".join(copy))
    texts.insert(60, " ".join(words))
    texts += [" ".join(words[:200] + [f"y{i}_{j}" for j in range(200)]) for i in range(60)]
    kept = {r.doc_id for r in simhash.keep_dissimilar(docs_of(spark, texts)).collect()}
    assert kept == {0, *range(121, 181)}


def test_keep_dissimilar_without_original(spark, monkeypatch):
    """Copies of a text that is not in the table: most lie below the similarity, and each link between them counts."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(304)]
    texts = []
    for i in range(500):
        copy = list(words)
        for at in rnd.sample(range(304), 5):
            copy[at] = f"x{i}_{at}"
        texts.append(" ".join(copy))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(300)} for t in texts]
    root = list(range(500))
    for i in range(500):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= 0.8 * (600 - common) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    monkeypatch.setattr(similar, "PART_DOCS", 60, raising=False)  # several parts a bucket
    kept = {r.doc_id for r in simhash.keep_dissimilar(docs_of(spark, texts)).collect()}
    due = 500 - len(set(root))
    gone = 500 - len(kept)
    assert due > 20 and kept >= set(root) and gone >= 0.99 * due, (due, gone)


def test_keep_dissimilar_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (None, "a b"), (None, None), (7, "p q r"), (7, "a b"), (8, "z " * 300_000), (9, "Z " * 200_000)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, u int, node int")
    kept = simhash.keep_dissimilar(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, (r.text or "")[:5]) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(1, ""), (4, "a b"), (6, "a b c"), (None, "a b"), (None, ""), (8, "z z z")], key=str)
    assert simhash.keep_dissimilar(docs.limit(0)).count() == 0


def test_simhash_empty(spark):
    assert simhash.near_duplicates(docs_of(spark, []).limit(0)).count() == 0


def test_suffixes(spark):
    rnd = random.Random(9)
    base = [words(rnd, rnd.randrange(1, 300)) for _ in range(25)]
    texts = [*base, None, "", "In. " * 300, "short"]
    for _ in range(25):
        a, b = rnd.choice(base), rnd.choice(base)
        at = rnd.randrange(max(1, len(a) - 380))
        texts.append(b[: rnd.randrange(200)] + " é " + a[at : at + rnd.randrange(380, 700)] + words(rnd, 10))
    texts += [base[0], base[1], base[1] + "!"]
    length, gram = 400, 128
    raws = [(t or "").encode() for t in texts]
    count = {}
    for raw in raws:
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            count[w] = count.get(w, 0) + 1
    out = {r.doc_id: r for r in suffix_dedup.dedup(docs_of(spark, texts), length, gram, with_text=True).collect()}
    for i, raw in enumerate(raws):
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if count[raw[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        assert (out[i].n_bytes, out[i].n_removed) == (len(raw), sum(gone)), i
        assert out[i].kept_sha256 == hashlib.sha256(kept).hexdigest() and bytes(out[i].kept) == kept
        assert out[i].n_spans == sum(len(x) > 0 for x in bytes(gone).split(b"\0"))


def test_suffix_buckets_meet_at_their_edges(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", 40)
    rnd = random.Random(2)
    core = words(rnd, 110)[:420]
    texts = [f"{words(rnd, 60)} {i} {core} {i} {words(rnd, 60)}" for i in range(12)]
    out = suffix_dedup.dedup(docs_of(spark, texts)).collect()
    assert [(r.n_spans, 422 <= r.n_removed <= 424) for r in out] == [(1, True)] * 12


def test_repeats_across_many_buckets(spark, monkeypatch):
    """Suffixes met twice are all found where a bucket holds few, with bytes on both sides of 128."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", 41)
    rnd = random.Random(3)
    keys = [bytes([lead]) * 8 + rnd.randbytes(12) for lead in (0, 1, 127, 128, 200, 255) for _ in range(300)]
    rows = [(k, i, b"h", 0) for i, k in enumerate(keys * 2)] + [(rnd.randbytes(20), -i, b"h", 0) for i in range(1, 300)]
    df = spark.createDataFrame(rows, "suffix binary, anchor long, hull binary, at int").repartition(5)
    got = [r.anchor for r in suffix_dedup._repeated(df, df.count()).collect()]
    assert sorted(got) == list(range(3600))


def test_quicksort_orders_bytes():
    rnd = random.Random(1)
    rows = [bytes(rnd.choice(b"\0\1\x80\xff") for _ in range(24)) for _ in range(3000)]
    tokens = suffix_dedup.np.frombuffer(b"".join(rows), ">u8").reshape(-1, 3).astype("u8")
    assert [rows[i] for i in suffix_dedup.multikey_quicksort(tokens)] == sorted(rows)


def test_suffixes_of_copies_and_other_columns(spark):
    rnd = random.Random(12)
    a, b = words(rnd, 200), words(rnd, 200)
    rows = [(1, a, "x"), (2, a, "y"), (2, a, "y"), (None, a, "z"), (3, b + a[100:700], "t"), (None, None, None), (4, b, "raw")]
    docs = spark.createDataFrame([(i, t, c, c, c) for i, t, c in rows], "doc_id long, text string, t string, raw string, weight string")
    for cap in (10, 0):  # with and without broadcast
        suffix_dedup.BROADCAST_DIGESTS, before = cap, suffix_dedup.BROADCAST_DIGESTS
        out = [(r.doc_id, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(docs, with_text=True).collect()]
        suffix_dedup.BROADCAST_DIGESTS = before
        assert sorted(out, key=str) == sorted([(1, len(a), 1, b""), (2, len(a), 1, b""), (2, len(a), 1, b""), (None, len(a), 1, b""), (3, len(b) + 600, 1, b""), (None, 0, 0, b""), (4, len(b), 1, b"")], key=str)


def test_suffixes_of_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 4096)
    suffix_dedup._TABLES.clear()
    rnd = random.Random(4)
    one = words(rnd, 3000, 10_000)
    texts = [one, one[5000:9000]]
    out = {r.doc_id: r for r in suffix_dedup.dedup(docs_of(spark, texts)).collect()}
    assert out[0].n_removed == out[1].n_removed == 4000


def test_suffixes_empty(spark):
    assert suffix_dedup.dedup(docs_of(spark, []).limit(0)).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def line_truth(texts, k, chars):
    lines = [(i, n, x) for i, t in enumerate(texts) for n, x in enumerate((t or "").split("\n")) if x.strip(SPACE)]
    first = {}
    for i, n, x in lines:
        first.setdefault(x, (i, n))
    close = {}
    for x in first:
        allowed = [y for y in first if first[y] < first[x] and abs(len(x) - len(y)) <= min(k, min(len(x), len(y)) // chars)]
        close[x] = any(edits(x, y) <= min(k, min(len(x), len(y)) // chars) for y in allowed)
    return {(i, n): ((i, n) != first[x], close[x]) for i, n, x in lines}


def marks(docs, **how):
    return {(r.doc_id, r.line_no): (r.copy, r.near) for r in line_dedup.dedup(docs, **how).collect()}


def test_lines(spark):
    rnd = random.Random(8)
    pool = [words(rnd, rnd.randrange(2, 16)) for _ in range(14)] + ["same", "sane", "", "  ", "ababababababababababab", "a" * 21, "short line"]
    texts = [None, ""]
    for _ in range(30):
        picked = []
        for line in (rnd.choice(pool) for _ in range(5)):
            for _ in range(rnd.randrange(4)):
                p = rnd.randrange(len(line) + 1)
                line = rnd.choice([line[:p] + line[p + 1 :], line[:p] + "é" + line[p:], line[:p] + "z" + line[p + 1 :]])
            picked.append(line)
        texts.append("\n".join(picked))
    for k, cap in ((2, 100), (1, 1)):
        assert marks(docs_of(spark, texts), edits=k, list_cap=cap) == line_truth(texts, k, line_dedup.CHARS_PER_EDIT), (k, cap)
    sums = {r.doc_id: r for r in line_dedup.summary(docs_of(spark, texts)).collect()}
    assert set(sums) == set(range(len(texts))) and sums[0].n_lines == 0
    truth = line_truth(texts, 2, line_dedup.CHARS_PER_EDIT)
    for r in line_dedup.without_repeats(docs_of(spark, texts)).collect():
        lines = (r.text or "").split("\n")
        assert r.kept_text == "\n".join(x for n, x in enumerate(lines) if not any(truth.get((r.doc_id, n), (False, False))))


def test_signatures_of_near_lines_are_near(spark):
    rnd = random.Random(21)
    pairs = []
    for _ in range(200):
        a = b = "".join(rnd.choice("abc dé漢") for _ in range(rnd.randrange(10, 60)))
        for _ in range(k := rnd.randrange(3)):
            p = rnd.randrange(len(b))
            b = rnd.choice([b[:p] + b[p + 1 :], b[:p] + "x" + b[p:], b[:p] + "y" + b[p + 1 :]])
        pairs.append((a, b, k))
    sig = [line_dedup._signature(F.col(c)).alias(c) for c in "ab"]
    out = spark.createDataFrame(pairs, "a string, b string, k int").select(*sig, "k").selectExpr("k", "bit_count(a.ones ^ b.ones) as n", "bit_count(a.twos ^ b.twos) as m").collect()
    assert all(r.n <= 2 * r.k and r.m <= 4 * r.k for r in out) and any(r.n for r in out) and any(r.m > r.n for r in out)


def test_lines_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "same line\nx", "i", "g", 0), (2, "same line\ny", "j", "h", 0)], "doc_id long, text string, _id string, _gone string, kept_text int")
    out = {r.doc_id: r for r in line_dedup.without_repeats(docs).collect()}
    assert set(out[1].asDict()) == {*docs.columns} and (out[2].kept_text, out[2]["_id"], out[2]["_gone"]) == ("y", "j", "h") and out[1].kept_text == "same line\nx"


def test_narrowing_meets_all_near_lines(spark):
    """Every list is over the cap, so links come from halved stretches alone, down to settled ones."""
    rnd = random.Random(13)
    base = "".join(rnd.choice("abc") for _ in range(23))
    lines = {base}
    for _ in range(160):
        line = base
        for _ in range(rnd.randrange(1, 4)):
            p = rnd.randrange(len(line) + 1)
            line = rnd.choice([line[:p] + line[p + 1 :], line[:p] + rnd.choice("abcd") + line[p:], line[:p] + rnd.choice("abcd") + line[p + 1 :]])
        lines.add(line)
    lines |= {x[:10] for x in lines} | {x[2:21] for x in lines}
    texts = rnd.sample(sorted(lines), len(lines))
    for k in (1, 2):
        assert marks(docs_of(spark, texts), edits=k, list_cap=0) == line_truth(texts, k, line_dedup.CHARS_PER_EDIT), k


def test_lines_of_a_template_make_no_square(spark):
    """2,000 lines that differ in a number of 12 digits: few pairs to verify, not two millions."""
    rnd = random.Random(14)
    texts = [f"order {rnd.randrange(10**12):012d} was sent to the customer and has been paid in full" for _ in range(2000)]
    texts += [texts[5].replace("paid", "pald"), texts[6][:-1], texts[7].replace("order", "oder").replace("full", "fulll")]
    posts, real = [], line_dedup.written

    def seen(df, name):
        out = real(df, name)
        posts.append((name, out.count()))
        return out

    line_dedup.written = seen
    try:
        got = marks(docs_of(spark, texts))
    finally:
        line_dedup.written = real
    assert {i for (i, _), (copy, near) in got.items() if near} == {2000, 2001, 2002}
    assert sum(n for name, n in posts if "pairs" in name) < 20_000, posts


def test_lines_of_odd_tables(spark):
    long = "x y" * 60_000
    rows = [(1, long, "a"), (1, long + "z", "b"), (None, "one line of some length\n\n \t", "c"), (None, "one line of some lenght", "d"), (2, None, "e")]
    docs = spark.createDataFrame([(i, t, c, c, 1) for i, t, c in rows], "doc_id long, text string, a string, line string, id int")
    out = line_dedup.dedup(docs).collect()
    assert sorted((r.doc_id, r.copy, r.near) for r in out if r.doc_id) == [(1, False, False), (1, False, True)]
    assert sum(r.near for r in out) == 2 and len(out) == 4


def test_lines_empty(spark):
    none = docs_of(spark, []).limit(0)
    assert line_dedup.summary(none).count() == 0
