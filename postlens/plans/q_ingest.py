"""Observation logs, crawl runs and source health."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import ingest
from postlens.plans.registry import query
from postlens.sources.bindings import EVENTS_AS_OF, Tables

_K = "institution_id, source_url"
_V = f"""select *, sum(changed) over (partition by {_K} order by seq) as version from (select *, (source_text_hash <> lag(source_text_hash) over (partition by {_K} order by seq))::int as changed0, coalesce(changed0, 0) as changed from observations)"""
_EACH = f"select {_K}, version, min(source_text_hash) as source_text_hash, min(raw_text) as raw_text, arg_min(parser_name, seq) as parser_name, arg_min(institution_name, seq) as institution_name, arg_max(fetched_at, seq) as last_at, arg_min(fetched_at, seq) as first_at from ({_V}) group by 1, 2, 3"
_CUR = f"""select {_K}, arg_max(source_text_hash, version) as source_text_hash, arg_max(raw_text, version) as raw_text, arg_max(parser_name, version) as parser_name, arg_min(institution_name, version) as institution_name,
    epoch(arg_max(last_at, version))::bigint as fetched_at, max(version)::bigint as changes from ({_EACH}) group by 1, 2"""
_SNAP = f"select * from (select {_K}, version, source_text_hash, raw_text, parser_name, last_at, lead(first_at) over (partition by {_K} order by version) as captured from ({_EACH})) where captured is not null"


def _epochs(df, *names):
    return df.withColumns({n: F.unix_timestamp(n) for n in names})


@query(_CUR)
def posting_current(t: Tables):
    return _epochs(ingest.posting_current(t.observations, t.keep), "fetched_at")


@query(f"select {_K}, version::bigint as version, source_text_hash, raw_text, parser_name, epoch(last_at)::bigint as last_seen_at, epoch(captured)::bigint as captured_at from ({_SNAP})")
def posting_snapshots(t: Tables):
    return _epochs(ingest.posting_snapshots(t.observations, t.keep), "last_seen_at", "captured_at")


@query(f"select {_K}, raw_text, row_number() over (partition by {_K} order by version desc) as rank from ({_SNAP}) qualify rank <= 20")
def posting_history(t: Tables):
    return ingest.posting_history(t.observations, keep=t.keep).select("institution_id", "source_url", "raw_text", "rank")


@query(f"select {_K}, epoch(fetched_at)::bigint as fetched_at, row_number() over (partition by {_K} order by seq) = 1 as is_new from observations")
def posting_new_flag(t: Tables):
    return _epochs(ingest.posting_new_flag(t.observations.select("institution_id", "source_url", "seq", "fetched_at"), t.keep).select("institution_id", "source_url", "fetched_at", "is_new"), "fetched_at")


_OUT = """select run_id, institution_id, coalesce(n, 0) as n_postings, case when e is not null then e when coalesce(n, 0) = 0 then 'zero_output' else 'success' end as outcome
    from (select r.run_id, i.institution_id from (select distinct run_id from outcomes) r, (select distinct institution_id from outcomes) i)
    left join (select run_id, institution_id, min(error_type) as e, sum(n_postings)::bigint as n from outcomes group by 1, 2) using (run_id, institution_id)"""


def _outcomes(t: Tables):
    # a run's targets are all institutions, by definition: runs (one row a day, broadcast) times targets rows
    runs = t.outcomes.select("run_id").distinct()
    targets = t.outcomes.select("institution_id").distinct().crossJoin(F.broadcast(runs))
    return ingest.run_outcomes(targets, t.outcomes)


@query(_OUT)
def run_outcomes(t: Tables):
    return _outcomes(t)


_RUNS = f"""select *, case when failure_count = 0 then 'completed' when failure_count >= targets then 'failed' else 'partial' end as status from (
    select run_id, sum(case when outcome = 'success' then n_postings else 0 end)::bigint as success_count, sum((outcome <> 'success')::int)::bigint as failure_count, count(*) as targets,
    coalesce(string_agg(distinct case when outcome <> 'success' then outcome end, ',' order by case when outcome <> 'success' then outcome end), '') as errors from ({_OUT}) group by 1)"""


def _summary(t: Tables):
    return ingest.run_summary(_outcomes(t)).withColumn("errors", F.array_join("errors", ","))


@query(_RUNS)
def run_summary(t: Tables):
    return _summary(t)


@query(f"""select run_id, institution_id, (sum(case when outcome = 'success' then n_postings else 0 end) over w)::bigint as success_so_far, (sum((outcome <> 'success')::int) over w)::bigint as failures_so_far
    from ({_OUT}) window w as (partition by run_id order by institution_id rows unbounded preceding)""")
def run_progress(t: Tables):
    return ingest.run_progress(_outcomes(t), keep=t.keep).select("run_id", "institution_id", "success_so_far", "failures_so_far")


@query(f"select * from ({_RUNS}) order by run_id desc limit 10")
def run_recent(t: Tables):
    return _summary(t).orderBy(F.desc("run_id")).limit(10)


@query(f"""select count(*) = 0 as due from (select * from (select run_id, institution_id, min(happened) as started_at, min(trigger) as trigger from outcomes group by 1, 2) order by started_at desc, run_id desc, institution_id desc limit 50)
    where trigger = 'auto' and started_at >= timestamp '{EVENTS_AS_OF}' - interval 24 hour""")
def run_gap_24h(t: Tables):
    runs = t.outcomes.groupBy(F.struct("run_id", "institution_id").alias("run_id")).agg(F.min("happened").alias("started_at"), F.min("trigger").alias("trigger"))
    return ingest.run_gap(runs, EVENTS_AS_OF)


@query("select id, enabled as target, 'all' as asked from institutions where enabled union all select id, enabled, 'list' from institutions where id in (1, 2, 3, 5, 10, 11)")
def run_targets(t: Tables):
    every, some = ingest.run_targets(t.institutions, None), ingest.run_targets(t.institutions, [1, 2, 3, 5, 10, 11, 10**9])
    return every.withColumn("asked", F.lit("all")).unionByName(some.withColumn("asked", F.lit("list"))).unionByName(ingest.run_targets(t.institutions, []).withColumn("asked", F.lit("none")))


_HLOG = """select institution_id, seq, sum((not ok)::int) over (partition by institution_id, island order by seq) as consecutive_failures
    from (select *, sum(ok::int) over (partition by institution_id order by seq) as island from outcomes)"""
_HEALTH = f"select institution_id, arg_max(consecutive_failures, seq)::bigint as consecutive_failures, max(seq) as last_seq from ({_HLOG}) group by 1"


@query(f"select *, case when consecutive_failures = 0 then 'success' when consecutive_failures >= 2 then 'review' else 'failed' end as status from ({_HEALTH})")
def source_health(t: Tables):
    return ingest.source_health(t.outcomes)


@query(f"select institution_id, consecutive_failures, count(*) over () as n_review from ({_HEALTH}) where consecutive_failures >= 2")
def source_health_review(t: Tables):
    return ingest.source_health_review(ingest.source_health(t.outcomes))


@query(f"select institution_id, seq, consecutive_failures::bigint as consecutive_failures from ({_HLOG})")
def source_health_log(t: Tables):
    return ingest.health_log(t.outcomes.select("institution_id", "seq", "ok"), t.keep).select("institution_id", "seq", "consecutive_failures")


@query("select sum(enabled::int)::bigint as enabled, count(*) as total from institutions")
def source_coverage(t: Tables):
    return ingest.source_coverage(t.institutions)


@query("select id, case when bad then 'https://org' || id || '.example/jobs' else listing_url end as listing_url, bad as repaired from (select *, crawl_strategy <> 'generic' and listing_url = official_url as bad from institutions)")
def source_url_repair(t: Tables):
    seeds = t.institutions.withColumn("listing_url", F.format_string("https://org%d.example/jobs", "id"))
    return ingest.source_url_repair(t.institutions, seeds).select("id", "listing_url", "repaired")


@query("""select l_orderkey % 2000 as user_id, l_partkey as job_id, count(*) as n, l_orderkey % 2000 in (select c_custkey from customer) and l_partkey in (select p_partkey from part where p_size < 30) as moved
    from lineitem group by 1, 2, 4""")
def orphan_split(t: Tables):
    rows = t.read("lineitem").select((F.col("l_orderkey") % 2000).alias("user_id"), F.col("l_partkey").alias("job_id"))
    users, jobs = t.read("customer").select(F.col("c_custkey").alias("user_id")), t.read("part").filter("p_size < 30").select(F.col("p_partkey").alias("job_id"))
    with_user, no_user = ingest.orphan_split(rows, users, ["user_id"])
    moved, no_job = ingest.orphan_split(with_user, jobs, ["job_id"])
    out = moved.withColumn("moved", F.lit(True)).unionByName(no_user.unionByName(no_job).withColumn("moved", F.lit(False)))
    return out.groupBy("user_id", "job_id", "moved").agg(F.count(F.lit(1)).alias("n"))


_PURGE = "select c_custkey from customer where c_name like 'Customer#0000000_1' or c_name = 'Customer#000000002' or regexp_matches(c_name, '^Customer#.*77$')"


@query(f"select o_custkey as user_id, 'orders' as child, count(*) as n from orders where o_custkey in ({_PURGE}) group by 1 union all select -1, 'orders kept', count(*) from orders where o_custkey not in ({_PURGE})")
def account_purge(t: Tables):
    accounts = t.read("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    targets = ingest.match_accounts(accounts, ["Customer#0000000?1", "Customer#*77"], ["Customer#000000002"])
    counts, kept = ingest.account_purge(targets, {"orders": t.read("orders").withColumnRenamed("o_custkey", "user_id")})
    return counts.unionByName(kept["orders"].agg(F.count(F.lit(1)).alias("n")).select(F.lit(-1).cast("long").alias("user_id"), F.lit("orders kept").alias("child"), "n"))
