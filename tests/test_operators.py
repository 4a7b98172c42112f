"""Golden rows of table operators, and streams against their batch results."""

import os
import random
import threading
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import duckdb
import pytest
from postlens.functions import text as T
from postlens.lexicon import ZH_MEDICAL
from postlens.operators import drafts, extract, imports, ingest, intervals, market, matching, postings, profiles, running, subscriptions
from postlens.plans import catalog
from postlens.plans.registry import with_tables
from postlens.sources import pages, sinks
from postlens.streaming import streams
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)


def at(n):
    return T0 + timedelta(days=n)


OBS = "institution_id long, source_url string, source_text_hash string, raw_text string, parser_name string, institution_name string, fetched_at timestamp, seq long"


def observations(spark, rows):
    return spark.createDataFrame([(i, u, h, h, "p", name, at(n), n) for n, (i, u, h, name) in enumerate(rows)], OBS)


def test_versions(spark):
    log = observations(spark, [(1, "u", "A", "first"), (1, "u", "B", "second"), (1, "u", "A", "third"), (2, "u", "A", "x"), (2, "u", "A", "y"), (1, "v", "A", "z")])
    now = {(r.institution_id, r.source_url): r for r in ingest.posting_current(log).collect()}
    assert len(now) == 3 and now[1, "u"].raw_text == "A" and now[1, "u"].institution_name == "first" and now[1, "u"].changes == 2
    assert now[2, "u"].fetched_at == at(4)
    old = sorted((r.version, r.raw_text, r.last_seen_at, r.captured_at) for r in ingest.posting_snapshots(log).collect())
    assert old == [(0, "A", at(0), at(1)), (1, "B", at(1), at(2))]


def shuffled_slices(log, seed, folder, start):
    """Slices of a log arrive in any order, some twice; start is run after each."""
    rnd = random.Random(seed)
    order = [0, 1, 2, 3, 4, 1, 3]
    rnd.shuffle(order)
    for k in order:
        log.filter(f"seq % 5 = {k}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        start(log.sparkSession.readStream.schema(log.schema).parquet(f"{folder}/in"), f"{folder}/c", f"{folder}/t").awaitTermination()


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_versions_equal_the_batch(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows = [(n % 3, f"u{n % 2}", rnd.choice("AAB"), f"n{n}") for n in range(60)]
    log = observations(spark, rows)
    shuffled_slices(log, seed, tmp_path, streams.stream_posting_upsert)
    assert sorted(map(tuple, streams.current(spark, f"{tmp_path}/t").collect())) == sorted(map(tuple, ingest.posting_current(log).collect()))
    assert sorted(map(tuple, streams.snapshots(spark, f"{tmp_path}/t").collect())) == sorted(map(tuple, ingest.posting_snapshots(log).collect()))


def test_a_late_observation_parts_a_run(spark, tmp_path):
    log = observations(spark, [(1, "u", "A", "x"), (1, "u", "B", "y"), (1, "u", "A", "z")])
    for part in ("seq <> 1", "seq = 1"):
        log.filter(part).write.mode("append").parquet(f"{tmp_path}/in")
        streams.stream_posting_upsert(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/c", f"{tmp_path}/t").awaitTermination()
    assert sorted((r.version, r.raw_text, r.last_seen_at, r.captured_at) for r in streams.snapshots(spark, f"{tmp_path}/t").collect()) == [(0, "A", at(0), at(1)), (1, "B", at(1), at(2))]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_streamed_health_equals_the_batch(spark, tmp_path, seed):
    rnd = random.Random(seed)
    log = spark.createDataFrame([(n % 3, n, n % 3 != 2 and rnd.random() < 0.3) for n in range(45)], "institution_id long, seq long, ok boolean")
    shuffled_slices(log, seed, tmp_path, streams.stream_source_health)
    got = sorted(map(tuple, streams.health(spark, f"{tmp_path}/t").collect()))
    last = {r.institution_id: r for r in ingest.health_log(log).orderBy("seq").collect()}
    assert [r[:3] for r in got] == [(i, last[i].consecutive_failures, last[i].seq) for i in sorted(last)] and got == sorted(map(tuple, ingest.source_health(log).collect()))
    assert spark.read.parquet(f"{tmp_path}/t/outcomes").filter("institution_id = 2").count() >= 15  # a source without any success keeps its failures


@pytest.fixture
def keep(spark, tmp_path):
    """Writes tables as queries do, with many small range partitions that stay."""
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    kept = {}

    def put(df, name):
        path = f"{tmp_path}/{name}-{len(kept)}"
        df.write.parquet(path)
        kept[path] = spark.read.schema(df.schema).parquet(path)
        return kept[path]

    put.kept = kept
    yield put
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_totals_of_a_hot_key(spark, keep):
    """Half of the rows have one key: they stand in many segments, and the sums and maxima are the plain ones."""
    rnd = random.Random(5)
    rows = [(None if i % 41 == 0 else 7 if i % 2 else i % 13, rnd.randrange(200), i, rnd.choice([None, 1, 2, -3])) for i in range(900)]
    out = running.running(spark.createDataFrame(rows, "k long, o long, i long, v long"), ["k"], ["o"], keep, {"s": F.col("v")}, {"m": F.col("v")}).collect()
    at, best = {}, {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        at[r[0], r[2]] = at.get(r[0], 0) + (r[3] or 0)
        at[r[0]] = at[r[0], r[2]]
        best[r[0], r[2]] = best[r[0]] = max((x for x in (best.get(r[0]), r[3]) if x is not None), default=None)
    assert len(out) == len(rows) and all((x.s, x.m) == (at[x.k, x.i], best[x.k, x.i]) for x in out)
    placed = next(t for p, t in keep.kept.items() if "running-rows" in p)
    spread = placed.filter("k = 7").groupBy("_segment").count().collect()
    assert len(spread) >= 4 and max(r["count"] for r in spread) < 300


def test_long_runs_and_logs_by_segments(spark, keep):
    rnd = random.Random(9)
    outcomes = spark.createDataFrame([(1 if i % 3 else 2, i, rnd.choice(["success", "network"]), i % 5) for i in range(300)], "run_id long, institution_id long, outcome string, n_postings long")
    assert sorted(map(tuple, ingest.run_progress(outcomes, keep=keep).collect())) == sorted(map(tuple, ingest.run_progress(outcomes).collect()))
    log = spark.createDataFrame([(i % 2 * (i % 5), i, rnd.random() < 0.2) for i in range(300)], "institution_id long, seq long, ok boolean")
    got, n = {(r.institution_id, r.seq): r.consecutive_failures for r in ingest.health_log(log, keep).collect()}, {}
    for i, seq, ok in sorted(map(tuple, log.collect()), key=lambda r: r[1]):
        n[i] = 0 if ok else n.get(i, 0) + 1
        assert got[i, seq] == n[i]
    assert sorted(map(tuple, ingest.health_log(log).collect())) == sorted((i, s, ok, got[i, s]) for i, s, ok in map(tuple, log.collect()))


def test_versions_by_segments(spark, keep):
    """One posting has half of the rows: it stands in many segments, and versions are those of one window. Null hashes and keys included."""
    rnd = random.Random(11)
    rows = [((1, "hot") if n % 2 else (None, "u") if n % 40 == 0 else (n % 3, f"u{n % 5}"), rnd.choice(["A", "B", "B", "B", None])) for n in range(600)]
    log = observations(spark, [(*k, h, f"n{n % 4}") for n, (k, h) in enumerate(rows)])
    log = log.unionByName(log.filter("seq % 50 = 0"))  # rows that repeat
    counted, at_key, seen = {}, {}, {}
    for n, (k, h) in enumerate(rows):
        at_key[k] = at_key.get(k, 0) + (k in seen and seen[k] != h)
        seen[k] = h
        counted[n] = at_key[k]
    got = ingest.versioned(log, keep).collect()
    assert len(got) == log.count() and all(r.version == counted[r.seq] for r in got)
    placed = next(t for p, t in keep.kept.items() if "running-rows" in p)
    spread = placed.filter("source_url = 'hot'").groupBy("_segment").count().collect()
    assert len(spread) >= 4 and max(r["count"] for r in spread) < 200
    same = lambda f: assert_same(f(log.dropDuplicates(["seq"])), f(log, keep=keep))
    for f in (ingest.posting_current, ingest.posting_snapshots, ingest.posting_history):
        same(f)
    once = log.dropDuplicates(["seq"])
    assert_same(ingest.posting_new_flag(once), ingest.posting_new_flag(once, keep))
    assert ingest.posting_snapshots(log.limit(0), keep).count() == 0 and ingest.posting_current(log.limit(0), keep).count() == 0


def assert_same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    x, y = (sorted(map(tuple, d.select(sorted(a.columns)).collect()), key=str) for d in (a, b))
    assert x == y


def test_references_come_in_pages(spark, keep):
    items = spark.createDataFrame([(1, 5, d % 130) for d in range(400)] + [(1, 6, 3), (2, 5, 9), (2, None, 1)], "user_id long, field_id long, draft_id long")
    pages = {(r.user_id, r.field_id, r.page): (r.n_drafts, r.draft_ids) for r in drafts.field_references(items, keep, page=50).collect()}
    assert pages == {(1, 5, p): (130, list(range(50 * p, min(50 * p + 50, 130)))) for p in range(3)} | {(1, 6, 0): (1, [3]), (2, 5, 0): (1, [9])}


@pytest.mark.parametrize("avg,low,failed,status", [(0.9, 0, 0, "stable"), (0.65, 0, 0, "watch"), (0.85, 25, 0, "watch"), (0.9, 0, 1, "review"), (0.9, 5, 0, "stable")])
def test_review_status(spark, avg, low, failed, status):
    q = spark.createDataFrame([("p", 100, low, 0, failed, avg)], "parser string, jobs long, low_confidence long, attachment_sourced long, failed_attachments long, avg_confidence double")
    assert market.review_status(q).first().status == status


def test_trust_slices_are_disjoint(spark):
    inst = spark.createDataFrame([(1, True), (2, False)], "id long, enabled boolean")
    jobs = spark.createDataFrame([(n, i, p) for n, (i, p) in enumerate([(i, p) for i in (1, 2, 3) for p in ("demo-fixture-v1", "generic-fallback-v1", "alpha", None)])], "id long, institution_id long, parser_name string")
    trust = {r.id: r.trust for r in postings.trust_class(jobs, inst).collect()}
    assert [trust[i] for i in range(4)] == ["fixture", "placeholder", "real", "real"] and {trust[i] for i in range(4, 12)} == {"disabled"}
    got = [i for s in ("real", "placeholder", "fixture", "disabled") for i in sorted(r.id for r in postings.filter_trust(jobs, inst, s).collect())]
    assert sorted(got) == list(range(8))


def test_dates_and_overlaps(spark):
    rows = [(1, "2020", "2021"), (2, "2020-07", "2020-12-31"), (3, "2020-09-01", "至今"), (4, "2024.03", ""), (5, "2024年3月", ""), (6, "2020-13", ""), (7, "2020-01-01", ""), (8, "2020-01-01", "soon")]
    df = spark.createDataFrame([(1, "education", *r) for r in rows], "user_id long, collection string, item_id long, start_raw string, end_raw string")
    iv = intervals.interval_build(df, "2024-01-01")
    known = {r.item_id: (str(r.start), str(r.end)) for r in iv.collect()}
    assert known[1] == ("2020-01-01", "2021-01-01") and known[3] == ("2020-09-01", "2024-01-01") and known[4] == known[5] == known[6] == ("None", "None") and known[8] == ("2020-01-01", "2020-01-01")
    pairs = {(r.left_id, r.right_id): r.ratio for r in intervals.overlap_pairs(iv).collect()}
    assert {(1, 2), (2, 3), (7, 8), (1, 7), (1, 8)} <= set(pairs) and pairs[7, 8] == 1.0


def test_overlaps_of_a_busy_user(spark):
    """Hundreds of entries of one user are cut into stretches; pairs are those of plain comparison, each once, wherever they begin."""
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        start = rnd.choice([rnd.randrange(0, 3000), rnd.randrange(1000, 1040)])
        rows.append((1 if i % 9 else 2, "ab"[i % 11 == 0], i, at(start).date(), at(start + rnd.choice([0, 0, 3, 20, 400, 2500])).date() if i % 5 else at(start - 3).date()))
    iv = spark.createDataFrame([*rows, (1, "a", 900, None, None)], "user_id long, collection string, item_id long, start date, end date")
    grid = intervals._grid(iv.filter("start is not null"))
    assert max(r["last"] for r in grid.collect()) >= 4

    def ratio(a, b):
        (s, e), (u, v) = ((x[3], max(x[3], x[4])) for x in (a, b))
        shared, shorter = (min(e, v) - max(s, u)).days, min((e - s).days, (v - u).days)
        return 0.0 if shared < 0 else float(shared == 0 and s == u) if shorter == 0 else shared / shorter

    want = {(a[2], b[2]): ratio(a, b) for a in rows for b in rows if a[2] < b[2] and a[:2] == b[:2] and ratio(a, b) >= 0.5}
    got = intervals.overlap_pairs(iv).collect()
    assert len(got) == len(want) and {(r.left_id, r.right_id): r.ratio for r in got} == want
    new = intervals.latest_entries(iv.filter("start is not null"))
    ids = {r.item_id for r in new.collect()}
    met = sorted((r.left_id, r.right_id) for r in intervals.overlap_new_item(iv, new).collect())
    assert met == sorted((x, y) for a, b in want for x, y in ((a, b), (b, a)) if x in ids) and met


@pytest.mark.parametrize("a,b,ratio", [(("2020-01-01", "2020-01-11"), ("2020-01-06", "2020-01-16"), 0.5), (("2020-01-01", "2020-01-01"), ("2019-12-01", "2020-02-01"), 0.0), (("2020-01-01", "2020-01-02"), ("2020-03-01", "2020-03-02"), 0.0)])
def test_overlap_ratio(spark, a, b, ratio):
    r = intervals.overlap_ratio(*[F.lit(x).cast("date") for x in (*a, *b)])
    assert spark.range(1).select(r.alias("r")).first().r == ratio


@pytest.mark.parametrize(
    "text,expected", [("2021.09-2024.06 大学", ("2021.09", "2024.06", "大学")), ("2023.01-至今 医院", ("2023.01", "至今", "医院")), ("2021-2024 x", ("2021", "2024", "x")), ("2021年9月至2024年6月 y", ("2021.9", "2024.6", "y")), ("none", ("", "", "none"))]
)
def test_time_range(spark, text, expected):
    assert tuple(spark.createDataFrame([(text,)], "t string").select(imports.time_range(F.col("t")).alias("r")).first().r) == expected


def test_headings_and_groups(spark):
    df = spark.createDataFrame([("【教育经历】",), ("一、教育经历",), ("# 教育经历",), ("x" * 21,), ("",)], "t string")
    assert [r[0] for r in df.select(imports.line_heading(F.col("t"))).collect()] == ["教育经历"] * 3 + [None] * 2
    lines = [(1, n, t) for n, t in enumerate(["2023-2024 医院 助理", "- 甲", "• 乙", "", "- 丙", "丁"])]
    got = imports.line_groups(spark.createDataFrame(lines, "doc_id long, line_no int, text string")).orderBy("line_no").collect()
    assert [(r.group, r.text) for r in got] == [(1, "2023-2024 医院 助理"), (1, "甲"), (1, "乙"), (2, "- 丙"), (3, "丁")]


def test_resume_import(spark):
    text = ["张三丰", "电话 13812345678 a.b@c.org", "2018-2021 北京大学 硕士 流行病学", "2021-2023 某医院 研究助理", "慢病队列项目 负责人", "护士资格证 2020", "英语 六级", "熟悉SPSS和Python，未掌握SAS"]
    blocks = imports.line_blocks(spark.createDataFrame([(1, n, t) for n, t in enumerate(text)], "doc_id long, line_no int, text string"))
    primary = imports.fact_primary(imports.facts(blocks))
    got = {r.collection: r.f for r in primary.collect()}
    assert {"education", "experiences", "projects", "certificates", "languages"} <= set(got)
    assert got["education"].name == "北京大学" and got["education"].role == "硕士" and got["experiences"].role == "研究助理" and got["languages"].role == "六级"
    assert {r.name for r in imports.skill_facts(blocks, primary).collect()} == {"SPSS", "Python"}
    basics = imports.doc_basics(blocks).first()
    assert (basics.name, basics.phone, basics.email) == ("张三丰", "13812345678", "a.b@c.org")


def test_matching_bars(spark):
    facts = [("a", "SPSS 统计 队列 随访 论文"), ("b", "护理 静脉 病区 护士"), ("c", "餐厅 收银")]
    asked = [(1, "熟悉SPSS等统计软件"), (2, "有护理工作经验"), (3, "驾驶大型货车")]
    clauses = spark.createDataFrame(asked, "req_id long, clause string")
    idf = spark.createDataFrame([("统计", 3.2), ("护理", 3.1), ("工作", 2.1), ("spss", 3.7)], "token string, idf double")
    best = matching.best_matches(matching.score_pairs(clauses, spark.createDataFrame(facts, "fact_id string, text string"), idf, ZH_MEDICAL))
    top = {r.req_id: r for r in best.filter("rank = 1").collect()}
    assert top[1].fact_id == "a" and top[2].fact_id == "b" and 3 not in top and all(0 < r.score <= 1 for r in top.values())


@pytest.mark.parametrize(
    "clause,level",
    [
        ("具有硕士（含）以上学历，本科为全日制本科", 3), ("硕士研究生及以上学历", 3), ("本科及以上学历", 2), ("具有博士研究生学历", 4), ("大专及以上学历", 1), ("护理学专业本科及以上学历", 2),
        ("本科，碩士以上学历", 2), ("本科点硕士学历", 2), ("大专点，硕士学历", 1), ("学士后流动站硕士学位", 2), ("博士优先", None), ("参与博士点建设申报工作", None), ("硕士后流动站，本科学历", 2),
    ],
)
def test_degree_floors(spark, clause, level):
    """The floor of a clause without its preferences and programmes."""
    assert spark.createDataFrame([(clause,)], "c string").select(T.degree_terms(F.col("c"))["required"]).first()[0] == level


@pytest.mark.parametrize(
    "clause,level,outcome",
    [
        ("具有硕士（含）以上学历", 3, "met"), ("大专及以上学历", 2, "met"), ("具有硕士（含）以上学历，本科为全日制本科", 2, "not_met"), ("具有硕士以上学历", None, "unknown"), ("具备良好的沟通协调能力", 2, None),
        ("基础医学、生物学或药学博士，具备英文论文写作能力和独立科研能力", 3, "not_met"), ("基础医学、生物学或药学博士，具备英文论文写作能力和独立科研能力", 4, None),
        ("基础医学、生物学或药学博士，具备英文论文写作能力和独立科研能力", None, None), ("具有博士学位者优先，发表过SCI论文", 2, None),
    ],
)
def test_degree_gates(spark, clause, level, outcome):
    row = spark.createDataFrame([(clause, level)], "c string, level int").select(T.degree_gate(F.col("c"), F.col("level"), F.lit("e")).alias("g")).first()
    assert (row.g.outcome if row.g else None) == outcome


def test_prefix_join_loses_no_pair(spark):
    """Pairs of a least score are those of the whole index over it, and the commonest tokens are not posted."""
    rnd = random.Random(6)
    words = ["spss", "队列", "随访", "护理", "论文", "沟通", "python", "gcp", "静脉", "病区", "统计", "团队"]
    say = lambda n: "".join(rnd.choice(words) for _ in range(n)) + " common " + " ".join(rnd.choice(["alpha", "beta", "common", "usual"]) for _ in range(n))
    clauses = spark.createDataFrame([("ab"[i % 2], (i, i % 3), say(rnd.randrange(1, 6))) for i in range(90)], "k string, req_id struct<job_id:long,ord:long>, clause string")
    facts = spark.createDataFrame([("ab"[i % 2], (i % 7, f"f{i}"), say(rnd.randrange(0, 4)) if i else None) for i in range(60)], "k string, fact_id struct<user_id:long,field_id:string>, text string")
    idf = matching.idf_build(clauses)
    whole = {(r.req_id, r.fact_id): r.score for r in matching.score_pairs(clauses, facts, idf, keys=("k",)).collect()}
    for least in (0.15, 0.5):
        got = {(r.req_id, r.fact_id): r.score for r in matching.score_pairs(clauses, facts, idf, keys=("k",), at_least=least).collect()}
        assert got == {k: v for k, v in whole.items() if v >= least} and got
    cut = matching._prefixes(matching._units(clauses, idf, ZH_MEDICAL, ["k"]), ["k"], 0.15).collect()
    assert any("common" in {u.token for u in r.rest} for r in cut)
    for r in cut:
        assert abs(sum(u.w for u in [*r.posted, *r.rest]) - r.whole) < 1e-9 and sum(u.w for u in r.rest) < 0.15 * r.whole and min(u.w for u in r.posted) >= max([u.w for u in r.rest], default=0)


def test_users_see_all_jobs_of_their_lists(spark):
    """Two users of one list see the same clauses, each with their own evidence, gate and gaps; a clause's number has no limit."""
    clauses = spark.createDataFrame([("a", (1, 20_000), "熟悉SPSS等统计软件"), ("a", (2, 0), "具有硕士及以上学历"), ("b", (3, 0), "驾驶大型货车")], "k string, req_id struct<job_id:long,ord:long>, clause string")
    views = spark.createDataFrame([(7, "a"), (8, "a"), (9, "b")], "user_id long, k string")
    pairs = spark.createDataFrame([(7, (1, 20_000), "f", 0.9)], "user_id long, req_id struct<job_id:long,ord:long>, fact_id string, score double")
    degrees = spark.createDataFrame([(7, 2, "e"), (8, 4, "d")], "user_id long, level int, field_id string")
    evidence, gaps = matching.evidence_gaps(clauses, views, pairs, degrees, keys=("k",))
    assert sorted((r.user_id, r.req_id.job_id, r.fact_id, r.strength) for r in evidence.collect()) == [(7, 1, "f", "strong"), (8, 2, "d", "strong")]
    assert sorted((r.user_id, r.req_id.job_id, r.blocking) for r in gaps.collect()) == [(7, 2, True), (8, 1, False), (9, 3, False)]
    both = [df.withColumn("job_id", F.col("req_id.job_id")) for df in (evidence, gaps)]
    summary = {(r.user_id, r.job_id): (r.met, r.total, r.degree_percent, r.blocking_gap) for r in matching.match_summary(*both, keys=("user_id", "job_id")).collect()}
    assert summary == {(7, 1): (1, 1, 100, False), (7, 2): (0, 1, 0, True), (8, 1): (0, 1, 0, False), (8, 2): (1, 1, 100, False), (9, 3): (0, 1, 0, False)}


def test_grids(spark):
    cells = [("f", "s", 1, ["通知", "", ""]), ("f", "s", 2, ["岗位", "", "学历"]), ("f", "s", 3, ["医师", "x", "硕士"]), ("f", "s", 4, ["", " ", ""]), ("g", "s", 1, ["岗位", "学历"])]
    df = spark.createDataFrame(cells, "attachment_url string, sheet string, row_index int, cells array<string>")
    head = extract.grid_header(df, ("岗位", "学历"))
    rows = extract.grid_rows(df, head).collect()
    assert [(r.row_index, r.raw_text) for r in rows] == [(3, "岗位：医师；学历：硕士")]
    assert extract.grid_postings(extract.grid_rows(df, head), {"title": ("岗位",), "education": ("学历",)}, "-").first().source_url == "f#s-3"


def test_page_events(spark):
    html = '<div class="main"><ul><li><a href="/a">Some job posting here</a> <span>2024-01-02</span></li></ul><script>x</script><a href="b.xlsx?q">list</a><img src="/i.png"></div><p>Line one</p><p>Line'
    page = spark.createDataFrame([(1, "http://h.org/d/p?x=1", html), (2, "http://h.org", None)], "page_id long, url string, html string")
    ev = pages.page_events(page)
    assert [(r.text, r.url) for r in extract.page_links(ev, page, ("job",)).collect()] == [("Some job posting here", "http://h.org/a")]
    assert [(r.posted_at, r.url) for r in extract.page_links_dated(ev, page).collect()] == [("2024-01-02", "http://h.org/a")]
    assert [(r.url, r.extension) for r in extract.page_attachment_links(ev, page).collect()] == [("http://h.org/d/b.xlsx?q", "xlsx")]
    assert [r.url for r in extract.page_images(ev, page).collect()] == ["http://h.org/i.png"]
    assert [r.text for r in ev.filter("kind = 'line' and pos > 5").collect()][-2:] == ["Line one", "Line"]
    assert {r.kind for r in extract.page_generic_postings(ev, page, ("job",)).collect()} == {"anchor", "page"}


def test_resumes_over_a_limit_are_turned_away(spark):
    texts = ["a\n b ", None, "x" * 10_001, "x\n" * 10_000, ("y" * 9000 + "\n") * 60, "z" * 10_000]
    lines, rejected = profiles.read_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(map(tuple, rejected.collect())) == [(2, "line"), (3, "lines"), (4, "characters")]
    assert sorted((r.doc_id, r.line_no, len(r.text)) for r in lines.collect()) == [(0, 0, 1), (0, 1, 1), (1, 0, 0), (5, 0, 10_000)]


def test_an_upsert_rewrites_the_partitions_it_touches(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id as k", "1L as seq", "concat('old ', id) as v")
    path, keys = f"{tmp_path}/table", ["k"]
    sinks.upsert_table(rows, path, keys, ["seq"], 50)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}
    before = files()
    few = spark.createDataFrame([(k, s, f"new {k}") for k, s in [(3, 2), (4, 0), (5, 2), (9999, 1)]], "k long, seq long, v string")
    for _ in range(2):  # a merge may run again
        table = sinks.upsert_table(few, path, keys, ["seq"], 50)
    got = {r.k: r.v for r in table.collect()}
    assert got == {k: f"old {k}" for k in range(2000)} | {3: "new 3", 5: "new 5", 9999: "new 9999"} and table.columns == ["k", "seq", "v"]
    same = {f for f, at in files().items() if before.get(f) == at}
    assert len({os.path.dirname(f) for f in files()} - {os.path.dirname(f) for f in same}) <= 4 and len(same) >= 46


def test_drafts(spark):
    items = spark.createDataFrame([(1, "a", 1, "adopt"), (1, "a", 2, None), (2, "a", 1, "edit")], "draft_id long, section_id string, pos int, decision string")
    got = {r.draft_id: (r.status, r.pending, r.first_pending) for r in drafts.review(items).collect()}
    assert got == {1: ("draft", 1, 1), 2: ("reviewed", 0, None)}
    lines = ["某医院 / 助理 / 2021-2023：甲；乙", "某医院", "甲；乙", " / ：x", ""]
    e = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "t string").select(drafts.entry_structure(F.col("t"))).collect()]
    assert tuple(e[0]) == ("某医院", "助理", "2021-2023", ["甲", "乙"]) and e[1].head == "某医院" and e[2].details == ["甲", "乙"]


def test_profiles(spark):
    docs = [(1, '{"basic": {"name": "n"}, "skills": [{"name": "R", "level": "熟练"}, 3, "x"], "education": [{"school": "s", "start": "2020", "highlights": ["h"]}]}'), (2, "broken")]
    p = {r.user_id: r for r in profiles.load_profiles(spark.createDataFrame(docs, "user_id long, data string")).collect()}
    assert p[1].basics.name == "n" and p[1].mode == "experienced" and [(s.name, s.level) for s in p[1].skills] == [("R", "advanced")] and p[2].skills == []
    f = {r.collection: r for r in profiles.fact_flatten(profiles.load_profiles(spark.createDataFrame(docs, "user_id long, data string"))).collect()}
    assert f["education"].text == "s h 学历 学位 专业" and f["education"].field_id == "education-1" and f["skills"].text == "R"


JOBS = "id long, institution_id long, title string, raw_text string, institution_name string, fetched_at timestamp"


def test_keywords_are_looked_for_in_institution_names(spark):
    rows = [(1, 9, "ICU", [1, 2], at(0), None), (2, 9, "ICU", [2], at(0), None), (3, 9, "医院a", [2], at(0), None), (4, 9, "RIC", [1], at(0), None), (5, 9, "icu", [3], at(0), None)]
    subs = spark.createDataFrame(rows, "id long, user_id long, keyword string, institution_ids array<long>, last_checked_at timestamp, last_pushed_at timestamp")
    inst = spark.createDataFrame([(n, True, "ok") for n in (1, 2, 3)], "id long, enabled boolean, last_status string")
    jobs = spark.createDataFrame([(1, 1, "t", "r", "RICU org", at(1)), (2, 2, "t", None, "org ICU 医院A", at(2)), (3, 3, None, "", "ICU", at(0))], JOBS)
    watching = subscriptions.active(subs, inst)
    got = sorted((r.id, r.job_id) for r in subscriptions.sub_new_jobs(watching, jobs).collect())
    assert got == [(1, 2), (2, 2), (3, 2)]  # RICU holds no word ICU, a keyword that is not ASCII matches as LIKE does, at(0) is not new
    assert sorted(r.id for r in subscriptions.sub_empty_30d(subs, watching, jobs, "2100-01-01").collect()) == [1, 2, 3, 4, 5]
    broad = {r.id: (r.matched, r.total, r.percent) for r in subscriptions.sub_broad_keyword(watching, jobs).collect()}
    assert broad == {2: (1, 1, 100), 3: (1, 1, 100), 5: (1, 1, 100)}


def test_keyword_index_finds_what_like_finds(spark):
    """A posting meets the keywords that share a rare piece with it and no others, wildcards and short keywords included."""
    words = ["ICU", "icu 护士", "护", "a", "50%", "x_z", "%", "__", "Ärzte", "nurse", "a.b", "護士長"] + [f"word{i:03d}x" for i in range(400)]
    asked = spark.createDataFrame([(i, w) for i in (1, 2) for w in words], "institution_id long, keyword string")
    texts = ["RICU Nurse", "icu 护士 word007x", "50 percent xyz", "", None, "ärzte 護士長", "a.b word123x word124x"]
    jobs = spark.createDataFrame([(i % 2 + 1, i, t, t if i % 3 else None, "org") for i, t in enumerate(texts * 3)], "institution_id long, job_id long, title string, raw_text string, institution_name string")
    met = subscriptions.keyword_candidates(asked, jobs, [0, 1, 2, 3])
    like = lambda k: postings.contains_like(F.concat_ws("|", "title", "raw_text", "institution_name"), F.col(k))
    got = sorted((r.job_id, r.keyword) for r in met.filter(like("keyword")).collect())
    want = sorted((r.job_id, r.keyword) for r in jobs.join(asked, "institution_id").filter(like("keyword")).collect())
    assert got == want and ("50%" in {k for _, k in got}) and met.count() <= len(want) + 5 * len(texts) * 3
    assert {r.keyword: r.gram for r in subscriptions.keyword_anchors(asked).collect()}["%"] == ""
    assert met.select("job_id", "keyword").distinct().count() == met.count()


WATCHING = "id long, user_id long, keyword string, institution_ids array<long>, last_checked_at timestamp, last_pushed_at timestamp"


def test_streamed_scan_pushes_once(spark, tmp_path):
    """Late and repeated postings are pushed once, postings before the checkpoint or too late never."""
    subs = spark.createDataFrame([(1, 9, "ICU", [1], at(0), None), (2, 9, "b", [1], at(0), at(3))], WATCHING)
    watching = subscriptions.active(subs, spark.createDataFrame([(1, True, "ok")], "id long, enabled boolean, last_status string"))
    arrivals = [[(40, "ICU b", 5), (41, "x", 5)], [(10, "ICU", 1), (40, "ICU b", 5)], [(20, "b", 2), (21, "b", 4), (10, "ICU", 1)], [(50, "ICU", 60), (51, "b", 61)], [(60, "ICU b", 20), (61, "ICU", 55)]]
    for rows in arrivals:
        jobs = spark.createDataFrame([(n, 1, t, "", "org", at(d)) for n, t, d in rows], JOBS)
        jobs.write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):
            streams.stream_sub_scan(spark.readStream.schema(jobs.schema).parquet(f"{tmp_path}/in"), watching, f"{tmp_path}/c", f"{tmp_path}/t", "30 days").awaitTermination()
    got = sorted((r.subscription_id, tuple(r.job_ids)) for r in streams.stored(spark, f"{tmp_path}/t", "notifications").collect())
    assert got == [(1, (10,)), (1, (40,)), (1, (50,)), (1, (61,)), (2, (21,)), (2, (40,)), (2, (51,))]


def test_overlapping_scans_push_once(spark, tmp_path, monkeypatch):
    """Two scans prepare their notifications before either is published; the second starts again and finds nothing new."""
    subs = spark.createDataFrame([(1, 9, "ICU", [1], at(0), None)], WATCHING)
    watching = subscriptions.active(subs, spark.createDataFrame([(1, True, "ok")], "id long, enabled boolean, last_status string"))
    jobs = spark.createDataFrame([(n, 1, "ICU", "", "org", at(n)) for n in range(1, 4)], JOBS)
    meet, publish, tried = threading.Barrier(2, timeout=60), streams._publish, []

    def together(session, staged, to):
        if len(tried) < 2:
            tried.append(to)
            meet.wait()
        return publish(session, staged, to)

    monkeypatch.setattr(streams, "_publish", together)
    with ThreadPoolExecutor(2) as pool:
        numbers = sorted(f.result() for f in [pool.submit(streams.scan_and_push, watching, jobs, f"{tmp_path}/t") for _ in range(2)])
    assert numbers == [0, 1] and [x.rsplit("/")[-1] for x in tried] == ["scan=0"] * 2
    assert [(r.subscription_id, sorted(r.job_ids)) for r in spark.read.parquet(f"{tmp_path}/t").collect()] == [(1, [1, 2, 3])]
    assert not [x for x in os.listdir(f"{tmp_path}/t") if x.startswith("_staged")]
    later = jobs.unionByName(spark.createDataFrame([(9, 1, "ICU", "", "org", at(9))], JOBS))
    assert streams.scan_and_push(watching, later, f"{tmp_path}/t") == 2
    assert sorted(n for r in spark.read.parquet(f"{tmp_path}/t").collect() for n in r.job_ids) == [1, 2, 3, 9]


def test_scan_uses_the_checkpoint_and_whole_words(spark):
    subs = spark.createDataFrame([(1, 9, "ICU", [1], at(1), None)], "id long, user_id long, keyword string, institution_ids array<long>, last_checked_at timestamp, last_pushed_at timestamp")
    inst = spark.createDataFrame([(1, True, "review")], "id long, enabled boolean, last_status string")
    titles = ["ICU", "ICU old", "RICU", "icu 护士", "ICU b", "x ICU", "ICU c"]
    jobs = spark.createDataFrame([(n, 1, t, "", "org", at(n)) for n, t in enumerate(titles)], JOBS)
    note = subscriptions.sub_scan(subscriptions.active(subs, inst), jobs).collect()
    assert [(n.job_count, n.job_ids, n.summary) for n in note] == [(4, [6, 5, 4, 3], "ICU c、x ICU、ICU b 等 4 条")]


def test_tables_come_before_those_that_name_them():
    sql = with_tables("select * from jobs")
    assert sql.index("institutions as (") < sql.index("jobs as (")


# whole forms of queries, against their SQL
def both(spark, name):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in ("lineitem", "orders", "events"):
        db.sql(f"create view {table} as select * from '{sf}/{table}.parquet'")
    mine = catalog.QUERIES[name](spark, sf)
    asked = db.sql(catalog.SQL[name])
    rows = sorted(map(tuple, mine.select(*asked.columns).collect()), key=str)
    assert rows == sorted(asked.fetchall(), key=str)
    return [dict(zip(asked.columns, r, strict=True)) for r in rows], db


def test_attachment_grid_of_all_rows(spark):
    rows, db = both(spark, "src_attachment_grid")
    assert sum(r["n"] for r in rows) == db.sql("select count(*) from lineitem").fetchall()[0][0]
    assert {"ok", "columns"} <= {r["state"] for r in rows}


def test_all_drafts_candidates_and_targets(spark):
    rows, db = both(spark, "draft_latest")
    assert len(rows) == db.sql("select count(distinct l_orderkey) from lineitem").fetchall()[0][0]
    both(spark, "overlap_new_item")
    for name in ("run_summary", "run_progress", "run_recent"):
        both(spark, name)
    rows, db = both(spark, "run_outcomes")
    assert {r["institution_id"] for r in rows} == {i for (i,) in db.sql("select distinct user_id from events").fetchall()}


def test_candidates_are_all_entries(spark):
    rows, db = both(spark, "overlap_new_item")
    pairs, _ = both(spark, "overlap_pairs")
    assert {(r["left_id"], r["right_id"]) for r in rows} == {p for r in pairs for p in ((r["left_id"], r["right_id"]), (r["right_id"], r["left_id"]))}
    assert rows


@pytest.mark.parametrize("name", ["page_article_lines", "page_generic_postings"])
def test_references_cut_before_their_semicolon(spark, tmp_path, name):
    texts = ["a &amp;&amp", "b &quot", "c &#39s &#39&#39", "d &#x27", "e &am", "f &amp;lt &amplt", "g &lt;&gt &copy &middot"]
    html = [f"<html><head><title>{x}</title></head><body><p>{x} y</p><div>{x}</div><p>z</p></body></html>" for x in texts]
    spark.createDataFrame([(n, f"https://x.example/{n}", h) for n, h in enumerate(html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    asked = db.sql(catalog.SQL[name])
    mine = [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).select(*asked.columns).collect()]
    assert sorted(mine, key=str) == sorted(asked.fetchall(), key=str)
    assert "a &&" in {r[1] for r in mine} and "b \"" in {r[1] for r in mine}


def test_word_searches_equal_their_patterns(spark):
    lines = ["Doi 10", "x GCP", "cet4", "CET-6 a", "n3", "技能：R", "x 技能", "技能 x", "获奖", "熟悉 SAS", "a 熟悉", "plain", "医院", "二等奖", *imports.NEGATED_WORDS, "未曾", "无相关", "未知"]
    rows = spark.createDataFrame([(x,) for x in lines], "s string")
    s = F.col("s")
    got = rows.select("s", imports.standalone(s).alias("a"), s.rlike(imports.STANDALONE).alias("b"), T.has(s, imports.NEGATED_WORDS).alias("c"), s.rlike(imports.NEGATED).alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in got) and {r.a for r in got} == {r.c for r in got} == {True, False}


def test_classes_and_skills_are_compiled(spark):
    rows = spark.createDataFrame([("证书\n无证书，熟悉SPSS；不会Python,R x", None), ("护士资格", "skills"), ("计划 护士资格证", "certificates")], "text string, hint string")
    out = rows.select(imports.block_classify(F.col("text"), F.col("hint")).alias("c"), imports.block_skills(F.col("text")).alias("s"))
    assert [(r.c, r.s) for r in out.collect()] == [(["certificates"], ["SPSS", "R语言"]), (["certificates"], []), ([], [])]
    assert "array_compact" not in (plan := out._jdf.queryExecution().analyzed().toString()) and "array_except" in plan


def test_page_events_leave_in_bounded_batches(spark):
    html = "<ul>" + "".join(f"<li><a href='/{n}'>job {n}</a></li>" for n in range(40)) + "</ul>"
    given = spark.createDataFrame([(n, html if n else None) for n in range(5)], "page_id long, html string")
    whole, small = pages.page_events(given), pages.page_events(given, most=500)
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str) and whole.count() == 4 * 120
