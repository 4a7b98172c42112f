"""Profile intervals, drafts, subscriptions and notifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import drafts as D
from postlens.operators import intervals as I
from postlens.operators import subscriptions as S
from postlens.plans.registry import query
from postlens.sources.bindings import AS_OF, Tables

_DATE = """case when lower(trim({c})) in ('至今', 'now', 'present', 'current') then date '{as_of}' when regexp_matches(trim({c}), '^\\d{4}(-\\d{1,2}){0,2}$')
    then try_cast(case length(trim({c})) - length(replace(trim({c}), '-', '')) when 0 then trim({c}) || '-01-01' when 1 then trim({c}) || '-01' else trim({c}) end as date) end"""


def _d(c: str) -> str:
    return _DATE.replace("{c}", c).replace("{as_of}", AS_OF)


_IV = f"""(select user_id, collection, item_id, s as "start", case when s is not null then coalesce(e, s) end as "end" from (select *, {_d('start_raw')} as s, {_d('end_raw')} as e from intervals))"""
_PAIRS = f"""with iv as (select user_id, collection, item_id, "start" as s, greatest("start", "end") as e from {_IV} where "start" is not null),
    p as (select a.user_id, a.collection, a.item_id as left_id, b.item_id as right_id, a.s as s1, b.s as s2, least(datediff('day', a.s, a.e), datediff('day', b.s, b.e)) as shorter, datediff('day', greatest(a.s, b.s), least(a.e, b.e)) as shared
        from iv a join iv b on a.user_id = b.user_id and a.collection = b.collection and {{apart}}),
    r as (select *, case when shared < 0 then 0.0::double when shorter = 0 then case when shared = 0 and s1 = s2 then 1.0::double else 0.0::double end else shared / shorter end as ratio from p)
    select user_id, collection, left_id, right_id, ratio from r where ratio >= 0.5"""


_ONCE = _PAIRS.replace("{apart}", "a.item_id < b.item_id")


def _intervals(t: Tables):
    return I.interval_build(t.intervals, AS_OF)


def _parsed(t: Tables):
    """Dates are parsed once, as both sides of a join and the grid read them."""
    return t.keep(_intervals(t).select("user_id", "collection", "item_id", "start", "end"), "intervals")


@query(f"select item_id, epoch({_d('start_raw')})::bigint as start_at, epoch({_d('end_raw')})::bigint as end_at from intervals")
def date_parse(t: Tables):
    return t.intervals.select("item_id", *[F.unix_timestamp(I.date_parse(F.col(f"{c}_raw"), AS_OF).cast("timestamp")).alias(f"{c}_at") for c in ("start", "end")])


@query(f'select item_id, datediff(\'day\', "start", "end") as days, "start" is null as unknown from {_IV}')
def interval_build(t: Tables):
    return _intervals(t).select("item_id", F.datediff("end", "start").cast("long").alias("days"), F.col("start").isNull().alias("unknown"))


@query(_ONCE)
def overlap_pairs(t: Tables):
    return I.overlap_pairs(_parsed(t))


@query(f"with q as ({_ONCE}) select user_id, left_id as item_id from q union select user_id, right_id from q")
def overlap_flagged(t: Tables):
    return I.overlap_flagged(I.overlap_pairs(_parsed(t)))


@query(_PAIRS.replace("{apart}", "a.item_id <> b.item_id"))
def overlap_new_item(t: Tables):
    """Every entry, as if it had just been added, against the user's other ones."""
    iv = _parsed(t)
    return I.overlap_new_item(iv, iv)


@query("select l_orderkey as user_id, sum((l_returnflag <> 'N' or l_linenumber = 2)::int)::bigint as n_nonblank, sum((l_returnflag <> 'N' or l_linenumber = 2)::int) = 0 as is_empty from lineitem group by 1")
def profile_nonblank(t: Tables):
    item = F.struct(F.col("l_linenumber").alias("id"), F.when(F.col("l_returnflag") == "N", " ").otherwise(F.col("l_returnflag")).alias("name"), F.when(F.col("l_linenumber") == 2, "x").alias("level"))
    profiles = t.read("lineitem").groupBy(F.col("l_orderkey").alias("user_id")).agg(F.collect_list(item).alias("skills"))
    return I.profile_nonblank(profiles, {"skills": ["name", "level"]}).select("user_id", "n_nonblank", "is_empty")


@query("select l_orderkey as user_id, count(*) as n from lineitem where l_returnflag <> 'N' group by 1")
def profile_fact_count(t: Tables):
    lines = t.read("lineitem").filter("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("user_id"))
    lists = lines.agg(*[F.collect_list(F.when(F.col("l_returnflag") == f, F.struct("l_linenumber"))).alias(n) for f, n in (("A", "education"), ("R", "awards"))])
    return lists.select("user_id", I.profile_fact_count(["education", "awards"]).alias("n"))


@query("select p_partkey as id, case p_size % 6 when 0 then 'advanced' when 1 then 'expert' when 2 then 'intermediate' when 3 then 'beginner' end as level from part")
def skill_level_map(t: Tables):
    raw = F.get(F.array(*map(F.lit, ("Advanced", "精通", " 掌握 ", "beginner", "", "unheard of"))), F.col("p_size") % 6)
    return t.read("part").select(F.col("p_partkey").alias("id"), I.skill_level_map(raw).alias("level"))


# drafts
@query("""select l_orderkey * 10 + l_linenumber as line, l_partkey, l_suppkey, l_returnflag || ' / ' || l_shipdate::date || case when l_linenumber % 2 = 0 then '：' || l_linestatus || '；' || l_suppkey else '' end as text, count(*) as n from lineitem group by all""")
def draft_item_text(t: Tables):
    l = t.read("lineitem")  # noqa: E741
    details = F.when(F.col("l_linenumber") % 2 == 0, F.array(F.col("l_linestatus"), F.lit(" "), F.col("l_suppkey").cast("string")))
    text = D.item_text([F.col("l_returnflag"), F.lit("")], F.lit(None).cast("string"), F.to_date("l_shipdate").cast("string"), details, F.lit(""))
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), "l_partkey", "l_suppkey", text.alias("text")).groupBy("line", "l_partkey", "l_suppkey", "text").agg(F.count(F.lit(1)).alias("n"))


@query("""select c_custkey as user_id, case when c_custkey % 3 = 0 then '（未填写姓名）' else c_name end || case when c_custkey % 5 = 0 then '' else '|电话：' || c_nationkey || ' ｜ 所在地：' || c_mktsegment end || '|' || c_mktsegment as lines
    from customer where not (c_custkey % 3 = 0 and c_custkey % 5 = 0)""")
def draft_identity(t: Tables):
    k, no = F.col("c_custkey"), F.lit("")
    basics = t.read("customer").select(
        k.alias("user_id"), F.when(k % 3 == 0, no).otherwise(F.col("c_name")).alias("name"), F.when(k % 5 == 0, no).otherwise(F.col("c_nationkey").cast("string")).alias("phone"), no.alias("email"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("location"), no.alias("intended_position"), F.col("c_mktsegment").alias("summary"),
    )
    return D.identity_lines(basics).select("user_id", F.array_join("lines", "|").alias("lines"))


@query("""select o_custkey as user_id, o_orderpriority as section, string_agg(o_orderkey::varchar, '|' order by o_orderstatus <> 'F', o_orderkey) as lines from orders group by 1, 2
    union all select o_custkey, 'gaps', string_agg(o_orderkey::varchar, '|' order by o_orderkey) from (select *, row_number() over (partition by o_custkey order by o_orderkey) as r from orders where o_orderstatus = 'O') where r <= 5 group by 1""")
def draft_sections(t: Tables):
    o = t.read("orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("collection"), F.col("o_orderkey").alias("idx"), F.col("o_orderkey").alias("field_id"), F.col("o_orderkey").cast("string").alias("text"), "o_orderstatus")
    gaps = o.filter("o_orderstatus = 'O'").select("user_id", F.col("idx").alias("ord"), F.col("text").alias("message"))
    return D.sections(o, o.filter("o_orderstatus = 'F'"), gaps).select("user_id", "section", F.array_join("lines", "|").alias("lines"))


_REVIEW = """select draft_id, case when bool_and(decision is not null) then 'reviewed' else 'draft' end as status, sum((decision is null)::int)::bigint as pending, min(case when decision is null then k end) as first_pending, count(*) as n_items
    from (select *, row_number() over (partition by draft_id order by pos) - 1 as k from draft_items) group by 1"""
_LOOSE = """select * from draft_items where section_id not in ('identity', 'target', 'gaps') and coalesce(decision, '') <> 'remove' and (field_id is null or field_id not in (select field_id from draft_facts))"""


@query(f"select draft_id, status from ({_REVIEW})")
def draft_status(t: Tables):
    return D.review(t.draft_items).select("draft_id", "status")


@query(f"select draft_id, pending, first_pending from ({_REVIEW})")
def draft_pending(t: Tables):
    return D.review(t.draft_items).select("draft_id", "pending", F.col("first_pending").cast("long").alias("first_pending"))


@query(f"select draft_id, section_id, text from ({_LOOSE})")
def draft_unlinked(t: Tables):
    return D.unlinked(t.draft_items, t.draft_facts).select("draft_id", "section_id", "text")


@query("select draft_id, section_id, coalesce(string_agg(case when coalesce(decision, '') <> 'remove' then text end, '|' order by pos), '') as lines from draft_items where section_id <> 'gaps' group by 1, 2")
def draft_export_view(t: Tables):
    return D.export_view(t.draft_items).select("draft_id", "section_id", F.array_join("lines", "|").alias("lines"))


@query(f"""select draft_id, n_unlinked, case when n_items = 0 then 422 when status <> 'reviewed' and draft_id % 4 <> 0 then 409 when draft_id % 2 = 1 and n_unlinked > 0 and draft_id % 4 <> 0 then 409 else 200 end::bigint as code
    from (select r.*, coalesce(n, 0) as n_unlinked from ({_REVIEW}) r left join (select draft_id, count(*) as n from ({_LOOSE}) group by 1) using (draft_id))""")
def draft_export_gate(t: Tables):
    return D.export_gate(D.review(t.draft_items), D.unlinked(t.draft_items, t.draft_facts), F.col("draft_id") % 2 == 1, F.col("draft_id") % 4 == 0).select("draft_id", "n_unlinked", "code")


@query("""with d as (select distinct user_id, field_id, draft_id from draft_items where field_id is not null),
    p as (select *, (row_number() over (partition by user_id, field_id order by draft_id) - 1) // 100 as page, count(*) over (partition by user_id, field_id) as n_drafts from d)
    select user_id, field_id, n_drafts, page, string_agg(draft_id::varchar, ',' order by draft_id) as draft_ids from p group by 1, 2, 3, 4""")
def field_references(t: Tables):
    return D.field_references(t.draft_items, t.keep).withColumn("draft_ids", F.array_join(F.transform("draft_ids", lambda x: x.cast("string")), ","))


@query("""select draft_id, text, decision, 'r ' || text || case when field_id is null then '' else ' — 证据：' || section_id || '：' || field_id end || ' — 强度：weak' as met,
    'r ' || text || ' — 建议：' || section_id || case when coalesce(decision = 'remove', false) then ' — （硬性条件不满足）' else '' end as unmet from draft_items where field_id is not null""")
def draft_appendix(t: Tables):
    rows = t.draft_items.filter("field_id is not null")
    r = F.concat(F.lit("r "), "text")
    return rows.select(
        "draft_id", "text", "decision", D.appendix_met(r, F.col("section_id"), F.col("field_id").cast("string"), F.lit("weak")).alias("met"),
        D.appendix_unmet(r, F.col("section_id"), F.coalesce(F.col("decision") == "remove", F.lit(False))).alias("unmet"),
    )


@query("""select l_orderkey as k, l_linenumber::bigint as n, case when l_linenumber = 4 then 'plain' else l_returnflag end as head, case when l_linenumber = 4 then null else l_linestatus || case when l_linenumber % 2 = 0 then '' else ' · x' end end as role,
    case when l_linenumber = 4 then null when l_linenumber % 2 = 0 then strftime(l_shipdate, '%Y-%m') end as period, case when l_linenumber % 3 = 0 then 'a|b' else '' end as details, count(*) as c from lineitem where l_linenumber <> 6 group by all""")
def entry_structure(t: Tables):
    n = F.col("l_linenumber")
    line = F.concat(
        F.when(n == 4, "plain").otherwise(F.concat_ws(" / ", "l_returnflag", "l_linestatus", F.when(n % 2 == 0, F.date_format("l_shipdate", "yyyy-MM")).otherwise("x"))), F.when(n % 3 == 0, "：a； b；").otherwise("")
    )
    e = t.read("lineitem").filter("l_linenumber <> 6").select(F.col("l_orderkey").alias("k"), n.cast("long").alias("n"), D.entry_structure(line).alias("e"))
    out = e.select("k", "n", "e.head", "e.role", "e.period", F.array_join("e.details", "|").alias("details"))
    return out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("c"))


@query("""select draft_id, 'draft ' || draft_id || chr(10) || chr(10) || string_agg(section_id || chr(10) || lines || chr(10), chr(10) order by p) as text
    from (select draft_id, section_id, min(pos) as p, string_agg('- ' || text, chr(10) order by pos) as lines from draft_items group by 1, 2) group by 1""")
def draft_plain_text(t: Tables):
    return D.plain_text(t.draft_items, F.format_string("draft %d", "draft_id"))


@query("""select draft_id, text, decision, case when decision = 'adopt' and field_id is not null then 'green' when field_id is not null and section_id = 'skills' then 'yellow' when section_id = 'education' then 'green' when section_id = 'experiences' then 'yellow' else 'red' end as tone from draft_items""")
def review_tone(t: Tables):
    strength = F.when(F.col("field_id").isNotNull(), F.when(F.col("decision") == "adopt", "strong").when(F.col("section_id") == "skills", "weak"))
    level = F.when(F.col("section_id") == "education", "matched").when(F.col("section_id") == "experiences", "supporting")
    return t.draft_items.select("draft_id", "text", "decision", D.review_tone(strength, level).alias("tone"))


@query("""with v as (select source as doc_id, coalesce(text, '') as text, lang as status from documents)
    select doc_id, 'control character' as rule, count(*) as n from v where regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') group by 1 union all select doc_id, 'value too long', count(*) from v where length(text) > 20000 group by 1
    union all select doc_id, 'unknown status', count(*) from v where status not in ('en', 'de', 'fr') group by 1 union all select doc_id, 'too many characters', sum(length(text))::bigint from v group by 1 having sum(length(text)) > 100000
    union all select doc_id, 'too many items', count(*) from v group by 1 having count(*) > 40""")
def text_constraints(t: Tables):
    v = t.read("documents").select(F.col("source").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("status"))
    return D.text_constraints(v, ("en", "de", "fr"), 20_000, 100_000, 40)


# subscriptions
_LC = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WATCH = "select *, unnest(institution_ids) as institution_id from subscriptions where not deleted"
_ACTIVE = f"select w.* from ({_WATCH}) w join institutions i on i.id = w.institution_id where i.enabled and i.last_status <> 'failed' and trim(keyword) <> ''"
_HITS = f"""select w.*, j.id as job_id, j.title, j.institution_name, j.raw_text, j.fetched_at from ({_ACTIVE}) w join jobs j on j.institution_id = w.institution_id
    where {_LC.format(c='j.title')} like '%' || {_LC.format(c='keyword')} || '%' or {_LC.format(c='j.raw_text')} like '%' || {_LC.format(c='keyword')} || '%'
    or {_LC.format(c='j.institution_name')} like '%' || {_LC.format(c='keyword')} || '%'"""
_WORD = "regexp_matches(title || ' ' || institution_name || ' ' || raw_text, '(?i)(^|[^A-Za-z0-9])' || replace(keyword, '.', '\\.') || '($|[^A-Za-z0-9])')"
_NEW = f"select * from (select *, row_number() over (partition by id order by fetched_at desc, job_id desc) as place from ({_HITS}) where fetched_at > last_checked_at) where place <= 100 and {_WORD}"


def _watching(t: Tables):
    return S.active(t.subscriptions.filter("not deleted"), t.institutions)


@query(f"select w.id as subscription_id, institution_id, not enabled or last_status = 'failed' as maintenance from ({_WATCH}) w join institutions i on i.id = w.institution_id")
def sub_maintenance(t: Tables):
    return S.sub_maintenance(t.subscriptions.filter("not deleted"), t.institutions)


@query(f"select id, job_id, place from ({_NEW})")
def sub_new_jobs(t: Tables):
    return S.sub_new_jobs(_watching(t), t.jobs).select("id", "job_id", F.col("place").cast("long").alias("place"))


@query(f"select id, coalesce(n, 0) as n_new from subscriptions left join (select id, count(*) as n from ({_NEW}) group by 1) using (id) where not deleted")
def sub_new_count(t: Tables):
    return S.sub_new_count(t.subscriptions.filter("not deleted"), S.sub_new_jobs(_watching(t), t.jobs))


@query(f"select id from subscriptions where not deleted and id not in (select id from ({_HITS}) where fetched_at >= timestamp '{AS_OF}' - interval 30 day and {_WORD})")
def sub_empty_30d(t: Tables):
    return S.sub_empty_30d(t.subscriptions.filter("not deleted"), _watching(t), t.jobs, AS_OF).select("id")


@query(f"""select id, matched, total, trunc(matched / total * 100)::bigint as percent from (select w.id, count(*) as total from ({_ACTIVE}) w join jobs j on j.institution_id = w.institution_id group by 1)
    join (select id, count(*) as matched from ({_HITS}) where {_WORD} group by 1) using (id) where matched / total > 0.5""")
def sub_broad_keyword(t: Tables):
    return S.sub_broad_keyword(_watching(t), t.jobs)


_SCAN = f"""select id as subscription_id, user_id, keyword, since, count(*) as job_count, string_agg(job_id::varchar, ',' order by fetched_at desc, job_id desc) as job_ids,
    array_to_string(list_slice(list(title order by fetched_at desc, job_id desc), 1, 3), '、') || case when count(*) > 3 then ' 等 ' || count(*) || ' 条' else '' end as summary
    from (select *, row_number() over (partition by id order by fetched_at desc, job_id desc) as place from (select *, coalesce(last_pushed_at, last_checked_at) as since from ({_HITS})) where fetched_at > since) where place <= 100 and {_WORD} group by 1, 2, 3, 4"""


@query(f"select * replace (epoch(since)::bigint as since) from ({_SCAN})")
def sub_scan(t: Tables):
    return S.sub_scan(_watching(t), t.jobs).drop("newest_at").withColumns({"since": F.unix_timestamp("since"), "job_ids": F.array_join(F.transform("job_ids", lambda x: x.cast("string")), ",")})


@query("select id, user_id, keyword, epoch(created_at)::bigint as created_at from subscriptions where not deleted")
def sub_list(t: Tables):
    return S.sub_list(t.subscriptions).select("id", "user_id", "keyword", F.unix_timestamp("created_at").alias("created_at"))


@query("""select s.id, epoch(coalesce(m, last_checked_at))::bigint as last_checked_at, epoch(last_pushed_at)::bigint as last_pushed_at from subscriptions s left join (select l_suppkey as id, max(l_shipdate)::timestamp as m from lineitem group by 1) v on v.id = s.id""")
def sub_mark_read(t: Tables):
    visits = t.read("lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_shipdate").cast("timestamp").alias("at"))
    return S.sub_mark_read(t.subscriptions, visits).select("id", F.unix_timestamp("last_checked_at").alias("last_checked_at"), F.unix_timestamp("last_pushed_at").alias("last_pushed_at"))


@query("""with f as (select list(id order by id) as ids from (select id from institutions where enabled order by id limit 12)), r as (select s.id, case when s.id % 5 = 0 then (select ids from f) when s.id % 7 = 0 then list_append(institution_ids, -1) else institution_ids end as ids from subscriptions s)
    select id, array_to_string(list_sort(ids), ',') as ids, (id % 5 <> 0 and id % 7 = 0)::bigint as unknown, not (id % 5 <> 0 and id % 7 = 0) and len(ids) between 1 and 12 as valid from r""")
def sub_defaults(t: Tables):
    k = F.col("id")
    asked = F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, F.concat("institution_ids", F.array(F.lit(-1).cast("long")))).otherwise(F.col("institution_ids"))
    return S.sub_defaults(t.subscriptions.select("id", asked.alias("institution_ids")), t.institutions).select("id", F.array_join(F.transform(F.array_sort("ids"), lambda x: x.cast("string")), ",").alias("ids"), "unknown", "valid")


_NOTES = "select o_orderkey as id, o_custkey as user_id, o_orderdate::timestamp as created_at, case when o_orderstatus = 'F' then o_orderdate::timestamp + interval 1 day end as read_at from orders"


def _notes(t: Tables):
    at = F.col("o_orderdate").cast("timestamp")
    return t.read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), at.alias("created_at"), F.when(F.col("o_orderstatus") == "F", F.timestamp_add("DAY", F.lit(1), at)).alias("read_at"))


@query(f"select id, user_id, row_number() over (partition by user_id order by created_at desc, id desc) as place from ({_NOTES}) qualify place <= 4")
def notif_list(t: Tables):
    return S.notif_list(_notes(t), 4).select("id", "user_id", "place")


@query(f"select user_id, sum((read_at is null)::int)::bigint as unread from ({_NOTES}) group by 1")
def notif_unread(t: Tables):
    return S.notif_unread(_notes(t))


@query(f"""with n as ({_NOTES}), r as (select o_custkey as user_id, l_orderkey as id, l_shipdate::timestamp as tm from lineitem join orders on l_orderkey = o_orderkey where l_linenumber = 1),
    e as (select c_custkey as user_id, timestamp '1998-06-01' as tm from customer where c_custkey % 3 = 0), f as (select user_id, id, min(tm) as tm from (select * from r union all select n.user_id, n.id, e.tm from n join e using (user_id) where e.tm >= n.created_at) group by 1, 2)
    select n.id, n.user_id, epoch(coalesce(n.read_at, f.tm))::bigint as read_at from n left join f on f.user_id = n.user_id and f.id = n.id""")
def notif_mark_read(t: Tables):
    one = t.read("lineitem").filter("l_linenumber = 1").join(t.read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_orderkey").alias("id"), F.col("l_shipdate").cast("timestamp").alias("at"))
    every = t.read("customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"), F.lit(None).cast("long").alias("id"), F.lit("1998-06-01").cast("timestamp").alias("at"))
    return S.notif_mark_read(_notes(t), one.unionByName(every)).select("id", "user_id", F.unix_timestamp("read_at").alias("read_at"))
