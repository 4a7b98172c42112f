"""Sources, posting queries and market analytics (institutions, jobs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import market, postings
from postlens.plans.registry import query
from postlens.sources.bindings import AS_OF, Tables
from postlens.sources.institutions import load_institutions, with_blocked_reason

_TRUST = """case when not coalesce(e.enabled, false) then 'disabled' when parser_name = 'demo-fixture-v1' then 'fixture'
    when parser_name in ('generic-visible-page-v1', 'generic-fallback-v1') then 'placeholder' else 'real' end"""
_LOW = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PAGE = ("id", "title", "institution_name", "region")


def _ids(jobs):
    return jobs.select(*_PAGE)


@query("select id, name, institution_type, region, official_url, listing_url, crawl_strategy, enabled from institutions")
def src_institutions(t: Tables):
    return load_institutions(t.institutions)


@query("select id, name, case when enabled then null when id % 10 = 0 then 'login required ' || region else 'not adapted yet' end as blocked_reason from institutions")
def src_blocked_reason(t: Tables):
    reasons = t.institutions.filter("id % 10 = 0").select("id", F.concat(F.lit("login required "), "region").alias("reason"))
    return with_blocked_reason(t.institutions, reasons, "not adapted yet").select("id", "name", "blocked_reason")


@query(f"select j.id, {_TRUST} as trust from jobs j left join institutions e on e.id = j.institution_id")
def trust_class(t: Tables):
    return postings.trust_class(t.jobs, t.institutions).select("id", "trust")


@query(f"select id, title, institution_name, region from jobs where {_LOW.format(c='title')} like '%urgent%' or {_LOW.format(c='raw_text')} like '%urgent%' or {_LOW.format(c='institution_name')} like '%urgent%'")
def filter_keyword(t: Tables):
    return _ids(postings.filter_keyword(t.jobs, "urGENT"))


@query("select id, title, institution_name, region from jobs where job_category = '2-HIGH' and institution_type = 'ASIA'")
def filter_equals(t: Tables):
    return _ids(postings.filter_equals(t.jobs, region="", job_category="2-HIGH", institution_type="ASIA"))


@query(f"select id, title, institution_name, region from jobs where len(list_filter(tags, lambda x: {_LOW.format(c='x')} like '%mach%')) > 0")
def filter_tag(t: Tables):
    return _ids(postings.filter_tag(t.jobs, "MACH"))


@query("""select j.id, title, institution_name, j.region, 'placeholder' as slice from jobs j join institutions e on e.id = j.institution_id where e.enabled and parser_name in ('generic-visible-page-v1', 'generic-fallback-v1')
    union all select j.id, title, institution_name, j.region, 'disabled' from jobs j join institutions e on e.id = j.institution_id where not e.enabled
    union all select j.id, title, institution_name, j.region, 'fixture' from jobs j join institutions e on e.id = j.institution_id where e.enabled and parser_name = 'demo-fixture-v1'
    union all select j.id, title, institution_name, j.region, 'real' from jobs j join institutions e on e.id = j.institution_id
        where e.enabled and (parser_name is null or parser_name not in ('demo-fixture-v1', 'generic-visible-page-v1', 'generic-fallback-v1'))""")
def filter_trust(t: Tables):
    slices = [_ids(postings.filter_trust(t.jobs, t.institutions, s)).withColumn("slice", F.lit(s)) for s in ("placeholder", "disabled", "fixture", "real")]
    return slices[0].unionByName(slices[1]).unionByName(slices[2]).unionByName(slices[3])


@query(f"select id, title, institution_name, region from jobs where fetched_at >= timestamp '{AS_OF}' - interval 400 day")
def filter_fresh_days(t: Tables):
    return _ids(postings.filter_fresh_days(t.jobs, 400, AS_OF))


@query("""with hit as (select * from jobs where job_category = '2-HIGH' and region like '%1')
    select id, title, institution_name, region, (select count(*) from hit) as total from hit order by fetched_at desc, id desc limit 100 offset 20""")
def jobs_list(t: Tables):
    hits = postings.filter_equals(t.jobs, job_category="2-HIGH").filter(F.col("region").endswith("1"))
    return postings.jobs_list(hits, 100, 20).select(*_PAGE, "total")


_FOLD = """select user_id, job_id, arg_max(status, seq) as status, arg_max(note, seq) as note, arg_min(happened, seq) as created_at, arg_max(happened, seq) as updated_at
    from (select *, max(life) over (partition by user_id, job_id) as last from (select *, sum(deleted::int) over (partition by user_id, job_id order by seq) as life from statuses)) where life = last and not deleted group by 1, 2"""


@query(f"select user_id, job_id, status, note, epoch(created_at)::bigint as created_at, epoch(updated_at)::bigint as updated_at from ({_FOLD})")
def status_upsert(t: Tables):
    return postings.status_upsert(t.statuses).withColumns({c: F.unix_timestamp(c) for c in ("created_at", "updated_at")})


@query(f"select j.id, title, institution_name, region, status, note from jobs j left join ({_FOLD}) s on s.job_id = j.id and s.user_id = 7")
def job_user_status(t: Tables):
    return postings.job_user_status(t.jobs, postings.status_upsert(t.statuses), 7).select(*_PAGE, "status", "note")


@query(f"""with h as (select job_id, count(*) as n_history, string_agg(status || ':' || note, ',' order by seq) as history from statuses group by 1)
    select j.id, {_TRUST} as trust, s.status, coalesce(n_history, 0) as n_history, coalesce(history, '') as history from jobs j left join institutions e on e.id = j.institution_id
    left join ({_FOLD}) s on s.job_id = j.id and s.user_id = 7 left join h on h.job_id = j.id""")
def job_detail_view(t: Tables):
    history = t.statuses.groupBy(F.col("job_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(":", "status", "note").alias("s")))).alias("h"))
    jobs = postings.job_user_status(postings.trust_class(t.jobs, t.institutions), postings.status_upsert(t.statuses), 7).join(history, "id", "left")
    none = F.coalesce(F.array_join(F.transform("h", lambda x: x["s"]), ","), F.lit(""))
    return jobs.select("id", "trust", "status", F.coalesce(F.size("h"), F.lit(0)).cast("long").alias("n_history"), none.alias("history"))


@query("""select user_id, draft_id, title, n_items, updated_at from (select *, row_number() over (partition by user_id order by updated_at desc, draft_id desc) as r from (
    select o_custkey as user_id, o_orderkey as draft_id, 'draft ' || o_orderpriority as title, coalesce(n, 0) as n_items, epoch(o_orderdate)::bigint as updated_at from orders left join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey))""")
def draft_list(t: Tables):
    n = t.read("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    drafts = t.read("orders").join(n, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return drafts.select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("draft_id"), F.concat(F.lit("draft "), "o_orderpriority").alias("title"), F.coalesce("n", F.lit(0)).alias("n_items"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("updated_at"),
    ).orderBy("user_id", F.desc("updated_at"), F.desc("draft_id"))


@query("select c_custkey as user_id, coalesce(s, 'empty') as summary, coalesce(v, 0) as version from customer left join (select o_custkey, arg_max(o_orderpriority, o_orderkey) as s, max(o_orderkey) as v from orders group by 1) on o_custkey = c_custkey")
def profile_latest(t: Tables):
    saved = t.read("orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("summary"), F.col("o_orderkey").alias("version"))
    users = t.read("customer").select(F.col("c_custkey").alias("user_id"))
    return users.join(postings.latest(saved, "user_id", "version"), "user_id", "left").fillna({"summary": "empty", "version": 0})


@query("""select l_orderkey as draft_id, arg_max(l_returnflag, row(l_shipdate, l_linenumber, l_partkey, l_suppkey)) as decision, count(*) as updates from lineitem group by 1""")
def draft_latest(t: Tables):
    seq = F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey").alias("seq")
    log = t.read("lineitem").select(F.col("l_orderkey").alias("draft_id"), F.col("l_returnflag").alias("decision"), seq)
    n = log.groupBy("draft_id").agg(F.count(F.lit(1)).alias("updates"))
    return postings.latest(log, "draft_id", "seq").drop("seq").join(n, "draft_id")


@query(f"""select id, case when age < 0 then '' when age <= 86400 then '新' when datediff('day', since::date, date '{AS_OF}') <= 1 then '今日' else '' end as tag
    from (select id, since, (epoch(timestamp '{AS_OF}') - epoch(since))::bigint as age from (select id, fetched_at + to_hours((id % 40)::int) as since from jobs))""")
def freshness_tag(t: Tables):
    at = F.timestamp_add("HOUR", (F.col("id") % 40).cast("int"), F.col("fetched_at"))
    return t.jobs.select("id", postings.freshness_tag(F.lit(None).cast("timestamp"), at, AS_OF).alias("tag"))


# market
_PQ = """select case when coalesce(parser_name, '') = '' then 'unknown' else parser_name end as parser, count(*) as jobs, sum((confidence < 0.65)::int)::bigint as low_confidence,
    count(attachment_url) as attachment_sourced, sum(failed_attachments)::bigint as failed_attachments, round_even(avg(confidence), 2) as avg_confidence from jobs group by 1"""
_REVIEW = f"select *, case when failed_attachments > 0 then 'review' when avg_confidence < 0.7 or low_confidence / jobs > 0.2 then 'watch' else 'stable' end as status from ({_PQ})"
_CAP = "select name, count(*) as n from (select unnest(tags) as name, region, institution_type, job_category from jobs) where name <> region and name <> institution_type and name <> job_category group by 1 order by n desc, name limit 20"
_EDU = "case when coalesce(education, '') = '' then '未注明' else education end"
_TOTALS = """select count(*) as jobs, count(distinct institution_id) as institutions, count(distinct region) as regions, count(distinct case when coalesce(parser_name, '') = '' then 'unknown' else parser_name end) as parsers,
    sum((confidence < 0.65)::int)::bigint as low_confidence, count(attachment_url) as attachment_sourced, sum(failed_attachments)::bigint as failed_attachments from jobs"""


@query(_TOTALS)
def agg_totals(t: Tables):
    return market.totals(t.jobs)


@query("select job_category as name, count(*) as n from jobs group by 1")
def agg_by_category(t: Tables):
    return market.group_count(t.jobs, "job_category")


@query(f"select {_EDU} as name, count(*) as n from jobs group by 1")
def agg_by_education(t: Tables):
    return market.group_count(t.jobs, "education")


@query("select institution_type as name, count(*) as n from jobs group by 1")
def agg_by_institution_type(t: Tables):
    return market.group_count(t.jobs, "institution_type")


@query("select region as name, count(*) as n from jobs group by 1")
def agg_by_region(t: Tables):
    return market.group_count(t.jobs, "region")


_FOCUS = "select *, row_number() over (partition by institution_name order by n desc, job_category) as rank from (select institution_name, job_category, count(*) as n from jobs group by 1, 2) qualify rank <= 5"


@query(_FOCUS)
def agg_institution_focus(t: Tables):
    return market.institution_focus(t.jobs)


@query(_CAP)
def agg_capabilities(t: Tables):
    return market.capabilities(t.jobs)


@query(_PQ)
def agg_parser_quality(t: Tables):
    return market.parser_quality(t.jobs)


@query(f"select parser, status, jobs from ({_REVIEW})")
def agg_review_status(t: Tables):
    return market.review_status(market.parser_quality(t.jobs)).select("parser", "status", "jobs")


@query(f"select bool_and(status = 'review') as all_review from ({_REVIEW})")
def agg_all_review(t: Tables):
    return market.all_review(market.review_status(market.parser_quality(t.jobs)))


@query(f"select {_TRUST} as trust, count(*) as n from jobs j left join institutions e on e.id = j.institution_id group by 1")
def agg_trust_breakdown(t: Tables):
    return postings.trust_class(t.jobs, t.institutions).groupBy("trust").agg(F.count(F.lit(1)).alias("n"))


_LINES = f"""with g as (select 1 as s, job_category as name, count(*) as n from jobs group by 2 union all select 2, region, count(*) from jobs group by 2 union all select 3, {_EDU}, count(*) from jobs group by 2 union all select 4, name, n from ({_CAP})),
    r as (select *, row_number() over (partition by s order by n desc, name) as k from g),
    f as (select institution_name, string_agg(job_category, '、' order by rank) as a, row_number() over (order by institution_name) as k from ({_FOCUS}) group by 1)
    select s * 1000 + k as pos, '- ' || name || ': ' || n as line from r where k <= [8, 10, 8, 10][s] union all select 5000 + k, '- ' || institution_name || ': ' || a from f where k <= 10
    union all select * from (values (0, '# report'), (1000, '## category'), (2000, '## region'), (3000, '## education'), (4000, '## capability'), (5000, '## focus'))"""


@query(_LINES)
def report_lines(t: Tables):
    return market.report_lines(t.jobs)


@query(f"select string_agg(line, chr(10) order by pos) as markdown from ({_LINES})")
def sink_report(t: Tables):
    return market.render_report(market.report_lines(t.jobs)).select("markdown")


@query(f"""with j as (select j.*, {_TRUST} as trust from jobs j left join institutions e on e.id = j.institution_id), tot as ({_TOTALS})
    select 'total' as section, name, n from (unpivot tot on jobs, institutions, regions, parsers, low_confidence, attachment_sourced, failed_attachments into name name value n)
    union all select 'job_category', job_category, count(*) from j group by 2 union all select 'education', {_EDU}, count(*) from j group by 2 union all select 'institution_type', institution_type, count(*) from j group by 2
    union all select 'region', region, count(*) from j group by 2 union all select 'trust', trust, count(*) from j group by 2
    union all select 'parser ' || status, parser, jobs from ({_REVIEW}) union all select 'capability', name, n from ({_CAP})""")
def analytics_summary(t: Tables):
    jobs = t.jobs.withColumn("trust", postings.trust_of(F.col("institution_enabled"), F.col("parser_name")))
    return market.summary(t.keep(market.cube(jobs), "market"))
