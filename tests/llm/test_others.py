"""Operators other than deduplication, against brute force, round trips or held-out rows."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from postlens.llm import chat, mixing, packing, sharding, topk, toxicity
from pyspark.sql import functions as F

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, copy string"


def docs_of(spark, texts, source=lambda i: f"s{i % 3}"):
    return spark.createDataFrame([(i, t, "en", source(i), 0, "clash", "clash") for i, t in enumerate(texts)], SCHEMA).repartition(3)


def sample_texts(n=300):
    rnd = random.Random(1)
    texts = [" ".join("w%d" % rnd.randrange(50) for _ in range(rnd.randrange(1, 400))) for _ in range(n)]
    return [*texts, None, "", "é" * 50, "x" * 90_000, texts[0], texts[0]]


# sharding
def test_sharding_is_whole_balanced_and_gapless(spark):
    texts = sample_texts()
    out = sharding.shard(docs_of(spark, texts), 7, slots=512).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(texts)))
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    loads, places = {}, {}
    for r in out:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(loads) == set(range(7))
    big = max(r.size for r in out)
    rest = [x for s, x in loads.items() if s != next(r.shard for r in out if r.size == big)]
    assert max(rest) - min(rest) < 0.1 * max(rest)


def test_sharding_with_a_hot_key(spark):
    """One doc_id in 30 percent of the rows, a third of those the very same row."""
    rows = [(7 if i % 10 < 3 else i, "same" * 9 if i % 10 == 0 else f"text {i} " * (i % 9 + 1)) for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sharding.shard(docs, 24)
    loads = {r.shard: (r.size, r.n, r.top) for r in out.groupBy("shard").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.max("slot").alias("top")).collect()}
    mean = sum(len(t) + 8 for _, t in rows) / 24
    assert len(loads) == 24 and sum(n for _, n, _ in loads.values()) == 20_000 and all(top == n - 1 for _, n, top in loads.values())
    assert max(size for size, _, _ in loads.values()) < 1.1 * mean and min(size for size, _, _ in loads.values()) > 0.9 * mean
    assert out.select("shard", "slot").distinct().count() == 20_000
    # an earlier map without sub-slots is carried on
    old = sharding.first_map(sharding.slot_stats(sharding.records_of(docs), spark, sharding.SLOTS), 24)
    again = sharding.shard(docs, 24, maps=old)
    assert again.count() == 20_000 and {r.map_version for r in again.select("map_version").distinct().collect()} == {1}
    assert sharding.shard(docs.limit(0), 3).count() == 0


def test_sharding_edits_its_map(spark):
    records = sharding.records_of(docs_of(spark, sample_texts()), 256)
    stats = sharding.slot_stats(records, spark, 256)
    first = sharding.first_map(stats, 4)
    second = sharding.rebalanced(first, stats, 4)
    size = {r.virtual_slot: r.slot_bytes for r in stats.collect()}
    old, new = ({r.virtual_slot: r.shard for r in m.collect()} for m in (first, second))
    assert set(new) == set(range(256)) and {r.version for r in second.collect()} == {1}
    load = lambda m: [sum(size[s] for s in m if m[s] == k) for k in range(4)]
    assert max(load(new)) <= max(load(old)) and sum(old[s] == new[s] for s in old) > 128
    third = sharding.grown(second, stats, 4)
    moved = {r.virtual_slot: r.shard for r in third.collect()}
    assert all(moved[s] in (new[s], 4) for s in new) and 4 in moved.values()
    kept = sharding.latest(second.unionByName(third)).collect()
    assert len(kept) == 256 and {r.version for r in kept} == {2}


def test_sharding_map_is_the_plain_greedy_deal(spark):
    """A rebalanced map keeps each shard's largest slots up to the mean and deals the rest, largest first, to the emptiest shard."""
    stats = sharding.slot_stats(sharding.records_of(docs_of(spark, sample_texts()), 64), spark, 64)
    size = {r.virtual_slot: r.slot_bytes for r in stats.collect()}
    mean, kept, pool = sum(size.values()) / 5, {}, []
    for k in range(5):
        total = 0
        for s in sorted((s for s in size if s % 5 == k), key=lambda s: (-size[s], s)):
            total += size[s]
            if total <= mean:
                kept[s] = k
            else:
                pool.append(s)
    load = [sum(size[s] for s in kept if kept[s] == k) for k in range(5)]
    for s in sorted(pool, key=lambda s: (-size[s], s)):
        kept[s] = load.index(min(load))
        load[kept[s]] += size[s]
    got = sharding.rebalanced(sharding.first_map(stats, 5), stats, 5).collect()
    assert {r.virtual_slot: r.shard for r in got} == kept


def test_sharding_of_nothing_and_null_ids(spark):
    docs = docs_of(spark, ["a", None])
    assert sharding.shard(docs.limit(0), 3, slots=16).count() == 0
    assert sharding.shard(docs.withColumn("doc_id", F.lit(None).cast("long")), 3, slots=16).count() == 2


# top-k
def brute_topk(rows, queries, k=10):
    fit = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in fit:
        if q is not None and q in queries:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in fit if i != q and len(w) == len(v))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found)}
    return out


@pytest.mark.parametrize("seed_rows,chunk,block", [(2048, 4096, 1 << 25), (16, 30, 4 * 16 * 8)])
def test_topk(spark, monkeypatch, seed_rows, chunk, block):
    monkeypatch.setattr(topk, "SEED_ROWS", seed_rows)
    monkeypatch.setattr(topk, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(topk, "BLOCK_BYTES", block)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=16) * rng.choice([0.1, 1, 5])).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 330)]
    rows += [(400, None), (500, [None] * 16), (600, [float("nan")] * 16), (700, [float("inf")] * 16), (800, [0.0] * 16), (900, [1.0, 2.0]), (1000, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash")).repartition(4)
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()}
    assert got == brute_topk(rows, {i for i, _ in rows if i % 20 == 0})


def test_topk_beyond_longs_and_of_repeated_ids(spark):
    huge = [(0, [2.0**60, 1.0]), (1, [2.0**70, -1.0]), (2, [1e300, 3.0]), (3, [-1e300, 0.0]), (4, [2.0**70, 5.0]), (5, [0.0, 0.0]), (6, [-(2.0**80), 1.0]), (7, [1e308, 1.0])]
    df = spark.createDataFrame(huge, "vec_id long, embedding array<double>")
    whole = lambda v: [math.floor(1024 * int(x)) if abs(x) > 2**40 else math.floor(1024 * x) for x in v]
    q = whole(huge[0][1])
    scores = sorted((-sum(a * b for a, b in zip(q, whole(v), strict=True)), i) for i, v in huge[1:7])  # 1e308 * 1024 is no double
    got = sorted(topk.top_k(df, F.col("vec_id") == 0).collect(), key=lambda r: r.rank)
    assert [r.vec_id for r in got] == [i for _, i in scores]
    assert [r.score for r in got] == [max(-(2**63), min(2**63 - 1, -s)) for s, _ in scores]
    twice = [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (1, [3.0, 0.0]), (1, [3.0, 0.0])]
    df = spark.createDataFrame(twice, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).collect())
    n = 1024 * 1024
    assert got == sorted([(0, 1, 1, 3 * n), (0, 2, 1, 3 * n), (0, 3, 0, 2 * n), (0, 1, 1, 6 * n), (0, 2, 1, 6 * n), (0, 3, 0, 2 * n)])


def test_topk_moves_what_is_reached_alone(spark, monkeypatch):
    """Short vectors that no query can reach stay where they are."""
    monkeypatch.setattr(topk, "CHUNK_ROWS", 50)
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=8) * (10 if i < 200 else 0.01)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen, real = {}, topk.written

    def look(df, name):
        seen[name] = real(df, name)
        return seen[name]

    monkeypatch.setattr(topk, "written", look)
    got = {tuple(r) for r in topk.top_k(df, (F.col("vec_id") % 20 == 0) & (F.col("vec_id") < 200)).collect()}
    assert got == brute_topk(rows, set(range(0, 200, 20)))
    reached = {r.bucket for r in seen["topk-met"].collect()}
    assert len(reached) < 12 and seen["topk-shape"].count() > 50


def test_topk_beyond_doubles_and_of_nothing(spark):
    rows = [(0, [2.0**18, 1.0]), (1, [2.0**18, 3.0]), (2, [2.0**18, 2.0]), (3, [-1.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).collect()} == brute_topk(rows[:4], {0})
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_pruning_keeps_all_results():
    rng = np.random.default_rng(1)
    fade = np.array([30.0] * 6 + [1.0] * 58)
    v = np.floor(rng.normal(size=(500, 64)) * 100 * fade * rng.uniform(0.2, 1, (500, 1)))
    norms = np.sqrt((v**2).sum(axis=1))
    order = np.argsort(-norms)
    v, norms = v[order], norms[order]
    pruned = 0
    for near in (0.3, 2.0):
        q = np.floor(v[5] + rng.normal(size=64) * 100 * near * fade)
        scores = v @ q
        threshold = np.sort(scores)[-10]
        at = topk._survivors(q, float(np.sqrt((q**2).sum())), threshold, v, norms)
        pruned += len(v) - len(at)
        assert set(np.flatnonzero(scores >= threshold)) <= set(at.tolist())
    assert pruned > 0


# mixing
def test_mixing(spark):
    texts = [f"text {i}" for i in range(4000)]
    docs = docs_of(spark, texts, lambda i: "hot" if i % 3 else ("rare" if i % 30 else None))
    weights = {"hot": 0.2, "rare": 0.5}
    out = mixing.mix(docs, weights, by="rows")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "copy", "n_copies", "rate", "shuffle_key"]
    rows = out.collect()
    share = lambda s: sum(r.source == s for r in rows) / len(rows)
    assert abs(share("hot") - 0.2) < 0.05 and abs(share("rare") - 0.5) < 0.05 and abs(share(None) - 0.3) < 0.05 and abs(len(rows) - 4000) < 400
    rates = {r.source: r.rate for r in rows}
    drawn = {r.doc_id: r.n_copies for r in rows}
    for i in range(4000):
        s = "hot" if i % 3 else ("rare" if i % 30 else None)
        u = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, p, c = 0, math.exp(-rates[s]), math.exp(-rates[s])
        while c <= u:
            k += 1
            p *= rates[s] / k
            c += p
        assert drawn.get(i, 0) == k
    assert rows != sorted(rows, key=lambda r: r.doc_id) and len({(r.doc_id, r.copy) for r in rows}) == len(rows)


def test_mixing_of_a_scarce_source(spark):
    """5 documents of 4,000 with half the weight are each repeated some 400 times."""
    docs = docs_of(spark, ["text"] * 4000, lambda i: "scarce" if i % 800 == 0 else "many")
    out = mixing.mix(docs, {"scarce": 0.5, "many": 0.5}, by="rows")
    rows = out.select("doc_id", "source", "copy", "n_copies", "rate").collect()
    scarce = [r for r in rows if r.source == "scarce"]
    assert {r.rate for r in scarce} == {400.0} and abs(len(scarce) - 2000) < 200 and abs(len(rows) - 4000) < 400
    drawn = {r.doc_id: r.n_copies for r in scarce}
    assert len(drawn) == 5 and len(set(drawn.values())) > 1
    assert sorted((r.doc_id, r.copy) for r in scarce) == sorted((i, k) for i, n in drawn.items() for k in range(n))


def test_mixing_of_nothing_and_empty_texts(spark):
    assert mixing.mix(docs_of(spark, ["a"]).limit(0)).count() == 0
    assert mixing.mix(docs_of(spark, [None, ""])).count() == 0  # no bytes, no rate


def test_mixing_with_clashing_names_and_without_ids(spark):
    docs = docs_of(spark, [f"t{i}" for i in range(600)]).withColumns({n: F.lit(n) for n in ("_source", "_n", "_part", "a b.c", "rate")}).withColumn("doc_id", F.lit(None).cast("long"))
    out = mixing.mix(docs, by="rows")
    assert out.columns == [c for c in docs.columns if c not in ("copy", "rate")] + ["copy", "n_copies", "rate", "shuffle_key"]
    rows = out.collect()
    assert all(r["_source"] == "_source" and r["a b.c"] == "a b.c" for r in rows)
    assert len({r.shuffle_key for r in rows}) == len(rows) and len({r.n_copies for r in rows}) > 2


# toxicity
def plain_ftrl(rows, epochs):
    """Per-coordinate FTRL-proximal as in its paper, a dictionary of coordinates and no numpy."""
    z, n, bias = {}, {}, [0.0, 0.0]
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= toxicity.L1 else (math.copysign(toxicity.L1, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)
    for _ in range(epochs):
        for places, y in rows:
            w = {i: weight(i) for i in places}
            b = -bias[0] / ((toxicity.BETA + math.sqrt(bias[1])) / toxicity.ALPHA)
            g = 1 / (1 + math.exp(-max(-30, min(30, sum(w.values()) + b)))) - y
            g *= toxicity.TOXIC_WEIGHT if y else 1
            for i in places:
                step = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - step * w[i], n.get(i, 0.0) + g * g
            step = (math.sqrt(bias[1] + g * g) - math.sqrt(bias[1])) / toxicity.ALPHA
            bias = [bias[0] + g - step * b, bias[1] + g * g]
    return {i: weight(i) for i in z if weight(i)} | {toxicity.INTERCEPT: -bias[0] / ((toxicity.BETA + math.sqrt(bias[1])) / toxicity.ALPHA)}


def test_ftrl_is_the_plain_one(monkeypatch):
    monkeypatch.setattr(toxicity, "L1", 0.5)
    rnd = random.Random(4)
    rows = [(np.array(sorted(rnd.sample(range(60), 12) + [99] * 0 + ([70] if i % 4 == 0 else []))), int(i % 4 == 0)) for i in range(120)]
    got, want = toxicity.ftrl(rows, 3), plain_ftrl([(r.tolist(), y) for r, y in rows], 3)
    assert set(got) == set(want) and 70 in got and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_toxicity_does_not_depend_on_partitions_or_names(spark):
    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.randrange(40)}" for _ in range(20)) + (" vile" if i % 5 == 0 else "") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    docs = docs_of(spark, texts).withColumns({n: F.lit(n) for n in ("_id", "_order", "_toxic", "_score", "a b.c")})
    one, two = (toxicity.fit(d, labels, rows_each=50) for d in (docs, docs.repartition(7)))
    assert one == two
    kept = toxicity.keep_clean(docs, labels, rows_each=50)
    assert kept.columns == docs.columns and all(r.score == "clash" and r["a b.c"] == "a b.c" and r["_score"] == "_score" for r in kept.collect())


def test_toxicity_learns_and_holds_out(spark):
    rnd = random.Random(2)
    texts, toxic = [], []
    for i in range(900):
        w = [f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(5, 120))]
        bad = i % 6 == 0
        if bad:
            w[rnd.randrange(len(w))] = rnd.choice(["vile", "awful"])
        texts.append(" ".join(w))
        toxic.append(int(bad))
    texts += [None, "", "vile " * 30_000]
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)] + [(5000, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, texts)
    out = {r.doc_id: r for r in toxicity.classify(docs, labels, rows_each=300).collect()}
    assert len(out) == len(texts)
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [i for i in out if out[i].held_out and i < 900] and all(out[i].held_out == (i in held) for i in range(900))
    assert sum(out[i].predicted == toxic[i] for i in held) >= 0.97 * len(held)
    assert out[902].predicted == 1 and out[900].score == out[901].score < 0.5
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.classify(docs, flipped, rows_each=300).collect()} == {i: r.score for i, r in out.items()}
    kept = toxicity.keep_clean(docs.drop("score"), labels, rows_each=300)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.predicted}


def test_toxicity_deals_an_id_that_repeats(spark):
    """An id with 15,000 texts is dealt to all learners, and no more rows are learnt than the bound says."""
    rows = spark.range(15_000).selectExpr("7L as doc_id", "concat('row ', id % 3000, ' word') as text").unionByName(spark.range(400).selectExpr("id + 100 as doc_id", "concat('plain ', id, if(id % 4 = 0, ' vile', '')) as text"))
    labels = spark.range(600).selectExpr("id as doc_id", "cast(id >= 100 and id % 4 = 0 as int) as toxic")
    seen = []
    real = toxicity.written
    toxicity.written = lambda df, name: seen.append((name, real(df, name))) or seen[-1][1]
    try:
        model = toxicity.fit(rows, labels, max_rows=2000, rows_each=250)
    finally:
        toxicity.written = real
    learnt = dict(seen)["toxicity-rows"]
    assert learnt.filter(f"turn = {learnt.groupBy('turn').count().orderBy(F.desc('count')).first().turn}").count() == 3000  # the same text once
    parts = dict(seen)["toxicity-weights"].filter(F.col("place") == toxicity.INTERCEPT).count()
    assert parts == 8 and len(model) > 1


def test_toxicity_of_nothing_and_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, ["a", None])
    assert [r.predicted for r in toxicity.classify(docs, labels).collect()] == [0, 0]
    assert toxicity.classify(docs.limit(0), labels).count() == 0


# packing
@pytest.fixture(scope="module")
def reference_tokenizer():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def test_ids_are_the_tokenizers(reference_tokenizer):
    rnd = random.Random(7)
    parts = ["the", "don't", " ", "  ", "\n", "\t", "é", "日本", "1234", "!?", "<|endoftext|>", "a b", " ", " ", "\x1c", "🙂", "'s", "x" * 60]
    texts = ["", " ", "a ", " a", "a  b", "a \n b", "<|endoftext|>", "a <|endoftext|> b"] + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 30))) for _ in range(1500)]
    encode = packing.encoder(TOKENIZER)
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == reference_tokenizer.encode(t, add_special_tokens=False).ids, t


def test_ids_of_long_white_space(reference_tokenizer):
    encode = packing.encoder(TOKENIZER)
    for t in ("a" + "\n" * 1_000_000 + "b", " " * 2_000_000, "x \t" + " \n" * 400_000):
        assert np.frombuffer(encode(t), "<u4").tolist() == reference_tokenizer.encode(t, add_special_tokens=False).ids


def test_packing_keeps_columns_of_any_name(spark):
    cut = packing.pieces(docs_of(spark, ["a", "b " * 3000, None]), TOKENIZER).withColumns({n: F.lit(n) for n in ("_group", "a b", "offset")})
    out = packing.pack(cut)
    assert out.columns == [c for c in cut.columns if c != "offset"] + ["sequence_id", "offset"]
    assert {(r["_group"], r["a b"]) for r in out.collect()} == {("_group", "a b")}


def test_packing_is_the_naive_best_fit():
    """The bitset's bins are those of a plain search among open bins, the fullest closing first."""
    rnd = random.Random(6)
    sizes = [rnd.randrange(1, 65) for _ in range(3000)]
    free, used, got = {}, 0, []
    for n in sizes:
        tight = min((f for f in free if f >= n and free[f]), default=None)
        if tight is None:
            if sum(map(len, free.values())) == 5:
                free[min(f for f in free if free[f])].pop()
            number, tight, used = used, 64, used + 1
        else:
            number = free[tight].pop()
        got.append((number, 64 - tight))
        if tight > n:
            free.setdefault(tight - n, []).append(number)
    assert list(packing.best_fit(iter(sizes), 64, 5)) == got


def test_packing(spark, reference_tokenizer):
    texts = sample_texts(120)
    out = packing.pack(packing.pieces(docs_of(spark, texts), TOKENIZER, with_ids=True), group_rows=60).collect()
    pieces = {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = reference_tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum((list(r.ids) for r in own), []) == ids
        assert all(r.start == sum(x.length for x in own[: r.piece]) and r.length == len(r.ids) for r in own)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
        assert len(own) == -(-len(ids) // 1024) and all(r.length == 1024 for r in own[1:])
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.1 * sum(r.length for r in out) / 1024 + 4


def test_packing_of_nothing(spark):
    assert packing.pack(packing.pieces(docs_of(spark, ["a"]).limit(0), TOKENIZER)).count() == 0


def test_best_fit_is_tight_and_bounded():
    assert list(packing.best_fit(iter([6, 7, 3, 4]), 10, 9)) == [(0, 0), (1, 0), (1, 7), (0, 6)]
    # of two open bins the fullest, which has 3 places, closes for the third
    assert list(packing.best_fit(iter([6, 7, 8, 3, 2]), 10, 2)) == [(0, 0), (1, 0), (2, 0), (0, 6), (2, 8)]
    rnd = random.Random(1)
    sizes = [rnd.randrange(1, 1024) for _ in range(20_000)]
    used = len({b for b, _ in packing.best_fit(iter(sizes))})
    assert used <= 1.03 * sum(sizes) / 1024


# chat
def test_chat_round_trip(spark):
    rnd = random.Random(3)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "\\l", "[OUT] x [/OUT]</s>", "é", "\n", " ", "hi", "]", "[ROLE a]"]
    said = lambda: "".join(rnd.choice(bits) for _ in range(rnd.randrange(6)))
    rows, truth = [], {}
    for c in range(60):
        turns = [(rnd.choice(["user", "assistant", "system", "tool]<x", "", "\\c", "a\\]c\\b", "]"]), said()) for _ in range(rnd.randrange(1, 7))]
        truth[c] = turns
        rows += [(c, t, role, text, "clash") for t, (role, text) in enumerate(turns)]
    rows += [(100, 0, None, None, ""), (None, 0, "assistant", "x" * 50_000, "")]
    truth |= {100: [("", "")], None: [("assistant", "x" * 50_000)]}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    out = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert set(out) == set(truth)
    for c, turns in truth.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for role, text in turns)
        assert out[c].n_turns == len(turns) and out[c].loss_chars == len(loss)
        assert out[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and out[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert out[c].formatted_chars == len(chat.instruct_template(turns))
        text = chat.instruct_template(turns)
        assert len(re.findall(r"<s>", text)) == len(turns)


def test_chat_finds_rewritten_history(spark):
    def forgetful(turns):  # shows the last turn alone, as templates that drop earlier thoughts do
        return "".join("<s>[INST] ... [/INST]" for _ in turns[:-1]) + chat.instruct_template(turns[-1:])

    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "..."), (2, 1, "user", "c")], "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_conversations(df, forgetful).collect()}
    assert out[1].rewritten_at == 1 and not out[1].loss_spans and out[2].rewritten_at is None and len(out[2].turn_spans) == 2
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_toxicity_sends_a_text_once(spark):
    docs = spark.createDataFrame([(1, "bad word", "en"), (2, None, "de"), (3, "", None)], "doc_id long, text string, lang string")
    model = {int(p): 0.5 for p in toxicity.features("bad word")} | {toxicity.INTERCEPT: -1.0}
    out = toxicity.score(docs, model)
    assert "read" not in out._jdf.queryExecution().analyzed().toString()
    binary = toxicity.score(docs.withColumn("text", F.col("text").cast("binary")), model)
    assert {r.doc_id: r.score for r in out.collect()} == {r.doc_id: r.score for r in binary.collect()} and out.columns == [*docs.columns, "score"]
