"""Pages, attachment grids, profiles, resume lines, sinks and streams."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from postlens.lexicon import SYNTH
from postlens.operators import extract as E
from postlens.operators import profiles
from postlens.plans import q_ingest, q_people
from postlens.plans.q_people import _watching
from postlens.plans.q_text import _ALL, _CAT, _EDU, _FIT, _NORM, _SCORES, _TAGS, _has, _q
from postlens.plans.registry import query
from postlens.sources import pages as P
from postlens.sources.bindings import Tables
from postlens.sources.sinks import shared_folder, upsert_table
from postlens.streaming import streams

WORDS = ("the", "der", "le", "ción")


def _pages(t: Tables):
    return t.read("pages").select("page_id", "url", "html")


def _events(t: Tables):
    return P.page_events(_pages(t))


# an attachment is fourteen parts in two sheets, so their number grows with part; two of three have a header
_CELLS = """select 'a' || (p_partkey // 14) as attachment_url, 's' || (p_partkey % 2) as sheet, row_number() over (partition by p_partkey // 14, p_partkey % 2 order by p_partkey) as row_index,
    case when p_partkey % 14 < 2 and p_partkey // 14 % 3 < 2 then ['Title', 'Unit', '', 'Degree'] else [p_name, p_brand, 'x', case when p_size % 5 = 0 then ' ' else p_type end] end as cells from part"""


def _cells(t: Tables):
    k = F.col("p_partkey")
    grid = F.call_function("div", k, F.lit(14))
    w = Window.partitionBy("attachment_url", "sheet").orderBy("p_partkey")  # seven rows
    cells = F.when((k % 14 < 2) & (grid % 3 < 2), F.array(*map(F.lit, ("Title", "Unit", "", "Degree")))).otherwise(F.array("p_name", "p_brand", F.lit("x"), F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.col("p_type"))))
    rows = t.read("part").select("p_partkey", F.format_string("a%d", grid).alias("attachment_url"), F.format_string("s%d", k % 2).alias("sheet"), cells.alias("cells"))
    return rows.withColumn("row_index", F.row_number().over(w)).drop("p_partkey")


@query("select page_id, url from (select *, row_number() over (partition by split_part(split_part(url, '://', 2), '/', 1) order by page_id) as n, split_part(split_part(url, '://', 2), '/', 1) as site from pages) where n <= case when site like 'm.%' then 2 else 3 end")
def src_pages(t: Tables):
    p = _pages(t).withColumns({"pos": F.col("page_id"), "host": F.regexp_extract("url", "://([^/]*)", 1)})
    mobile, rest = p.filter(F.col("host").startswith("m.")), p.filter(~F.col("host").startswith("m."))
    read = lambda df, n: P.read_pages(df, {}, n, site="host")
    return read(mobile, 2).unionByName(read(rest, 3)).select("page_id", "url")


def _grid_states(cells):
    ok, bad = E.read_grid(cells)
    n = cells.groupBy("attachment_url").agg(F.count(F.lit(1)).alias("n"))
    return ok.groupBy("attachment_url").agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.lit("ok")).unionByName(bad.join(n, "attachment_url").select("attachment_url", "n", F.col("reason").alias("state")))


_BLOCK = "l_orderkey // case l_suppkey % 7 when 1 then 50000 when 5 then 4000 else 1000 end"


@query(f"""with g as (select 'b' || (l_suppkey % 7) || '-' || ({_BLOCK}) as a, case l_suppkey % 7 when 3 then 130 when 5 then 100 else 3 end as w from lineitem),
    x as (select a, case when count(*) > 5000 then 'rows' when max(w) > 128 then 'columns' when sum(w) > 200000 then 'cells' end as reason, count(*) as n from g group by 1) select a as attachment_url, coalesce(reason, 'ok') as state, n from x""")
def src_attachment_grid(t: Tables):
    """Grids of all of lineitem: their number grows with it, and they lie on both sides of each limit."""
    m = F.col("l_suppkey") % 7
    block = F.call_function("div", F.col("l_orderkey"), F.when(m == 1, 50_000).when(m == 5, 4000).otherwise(1000))
    width = F.when(m == 3, 130).when(m == 5, 100).otherwise(3)
    cells = t.read("lineitem").select(F.format_string("b%d-%d", m, block).alias("attachment_url"), F.format_string("s%d", F.col("l_suppkey") % 2).alias("sheet"), F.col("l_linenumber").alias("row_index"), F.array_repeat(F.lit("x"), width).alias("cells"))
    return _grid_states(cells)


@query("""select c_custkey as user_id, case when c_custkey % 11 <> 0 then c_name end as name, case when c_custkey % 11 <> 0 and c_custkey % 5 = 0 then 'graduate' else 'experienced' end as mode,
    (c_custkey % 11 <> 0)::bigint as n_skills, case when c_custkey % 11 <> 0 then case c_custkey % 3 when 0 then 'advanced' when 1 then 'expert' end end as level from customer""")
def src_profiles(t: Tables):
    k = F.col("c_custkey")
    skill = F.to_json(F.struct(F.col("c_name").alias("name"), F.get(F.array(*map(F.lit, ("熟练", "expert", "nonsense"))), (k % 3).cast("int")).alias("level")))
    doc = F.concat(F.lit('{"basic": {"name": "'), F.col("c_name"), F.lit('"}, "skills": ['), skill, F.when(k % 4 == 0, ', 17, "broken"').otherwise(""), F.lit("]"), F.when(k % 5 == 0, ', "mode": "graduate"').otherwise(""), F.lit("}"))
    p = profiles.load_profiles(t.read("customer").select(k.alias("user_id"), F.when(k % 11 == 0, "not json").otherwise(doc).alias("data")))
    return p.select("user_id", F.col("basics.name").alias("name"), "mode", F.size("skills").cast("long").alias("n_skills"), F.get("skills", 0)["level"].alias("level"))


@query("""with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as x, length(coalesce(text, '')) as total from documents),
    j as (select *, case when len(x) > 10000 then 'lines' when total > 500000 then 'characters' when list_max(list_transform(x, lambda s: length(s))) > 10000 then 'line' end as rejected from d)
    select doc_id, unnest(range(1, len(x) + 1)) - 1 as line_no, trim(unnest(x)) as text, null as rejected from j where rejected is null
    union all select doc_id, null, null, rejected from j where rejected is not null""")
def src_resume_lines(t: Tables):
    """Lines, and a row for each document that is turned away, with the reason."""
    lines, rejected = profiles.read_lines(t.read("documents").select("doc_id", "text"))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text").unionByName(rejected, allowMissingColumns=True)


@query("""with l as (select l_partkey, l_returnflag, l_orderkey from lineitem qualify row_number() over (partition by l_partkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc, l_suppkey desc, l_quantity desc, l_returnflag desc) = 1)
    select l_returnflag as flag, count(*) as n, sum(l_orderkey)::bigint as keys from l group by 1""")
def sink_tables(t: Tables):
    """The newest line of each part, upserted in two loads; the second is some months of lines."""
    rows, path = t.read("lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag"), shared_folder(t.spark, "sink")
    for load in ("l_shipdate < date '1998-06-01'", "l_shipdate >= date '1998-06-01'"):
        table = upsert_table(rows.filter(load), path, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag"])
    return table.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


def _ranked(df):
    """Places in the page's order count from 1, as only a parser of the whole page knows its events."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("pos")).cast("long")).drop("pos")


#: The references that the given pages hold; the ampersand comes last, so that nothing is read twice.
_REFERENCES = {"&lt;": "'<'", "&gt;": "'>'", "&quot;": "'\"'", "&nbsp;": "chr(160)", "&copy;": "'©'", "&middot;": "'·'", "&#39;": "chr(39)", "&#x27;": "chr(39)", "&amp;": "'&'"}
_PLAIN = reduce(lambda c, kv: f"replace({c}, '{kv[0]}', {kv[1]})", _REFERENCES.items(), "{c}")
_TEXT = _NORM.format(c=_PLAIN.format(c="regexp_replace({c}, '<[^>]*>', '', 'g')"))
_A = '<a [^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
#: The anchors of a page, in order.
_ANCHORS = f"""select page_id, url, i as pos, {_PLAIN.format(c='hrefs[i]')} as href, {_TEXT.replace('{c}', 'texts[i]')} as text from (select *, unnest(range(1, len(hrefs) + 1)) as i from (
    select page_id, url, regexp_extract_all(html, '{_A}', 1) as hrefs, regexp_extract_all(html, '{_A}', 2) as texts from (select page_id, url, regexp_replace(html, '(?s)<script.*?</script>|<!--.*?-->', '', 'g') as html from pages)))"""
_HOST, _FREE = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)", "regexp_replace(url, '[?#].*$', '')"
_ABS = f"""case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then href when starts_with(href, '//') then regexp_extract(url, '^([a-z]+):', 1) || ':' || href when starts_with(href, '/') then {_HOST} || href when starts_with(href, '?') then {_FREE} || href
    when starts_with(href, '#') then regexp_replace(url, '#.*$', '') || href else case when regexp_matches({_FREE}, '^[a-z]+://[^/]*$') then {_FREE} || '/' else regexp_replace({_FREE}, '[^/]*$', '') end || href end"""


@query(f"select page_id, row_number() over (partition by page_id order by pos) as n, text, {_ABS} as url from ({_ANCHORS}) where length(text) > 4 and length(text) < 40 and {_has('text', WORDS)}")
def page_links(t: Tables):
    return _ranked(E.page_links(_events(t), _pages(t), WORDS, 4, 40))


@query(f"""select page_id, text, {_ABS} as url, regexp_extract(item, '(\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}})', 1) as posted_at from (select page_id, url, {_PLAIN.format(c=f"regexp_extract(item, '{_A}', 1)")} as href,
    {_TEXT.replace('{c}', f"regexp_extract(item, '{_A}', 2)")} as text, {_TEXT.replace('{c}', 'item')} as item from (select page_id, url, unnest(regexp_extract_all(html, '<li>(.*?)</li>', 1)) as item from pages)) where length(text) >= 4""")
def page_links_dated(t: Tables):
    return E.page_links_dated(_events(t), _pages(t), min_len=4)


#: Lines may end within a reference, as titles are cut, so it is read without its semicolon too, as HTML is. A number ends before
#: what is no digit, which is put back; what ends one number may begin the next, hence twice.
_NUMBERS = [("&#39;|&#39([^0-9;]|$)", "chr(39) || '\\1'"), ("&#x27;|&#x27([^0-9a-fA-F;]|$)", "chr(39) || '\\1'")] * 2
_NAMES = [(f"{k[:-1]};?", v) for k, v in _REFERENCES.items() if "#" not in k]
_READ = reduce(lambda c, kv: f"regexp_replace({c}, '{kv[0]}', {kv[1]}, 'g')", [*_NUMBERS, *_NAMES], "{c}")
_BREAKS = "<(/?)(p|div|li|br|tr|td|th|h1|h2|h3|h4|article|section|ul|ol|table|title)(\\s[^>]*)?/?>"
#: The text lines of the pages, in order: a block's tag ends a line, other tags don't, scripts and styles are not text.
_LINES = f"""select page_id, pos, text from (select page_id, i as pos, {_NORM.format(c=_READ.replace('{c}', 'parts[i]'))} as text from (select page_id, parts, unnest(range(1, len(parts) + 1)) as i from (select page_id, string_split(regexp_replace(regexp_replace(
    regexp_replace(replace(html, chr(10), ' '), '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '{_BREAKS}', chr(10), 'gi'), '<[^>]*>', '', 'g'), chr(10)) as parts from pages))) where text <> ''"""


@query(f"""with a as (select * from ({_ANCHORS}) where length(text) between 4 and 80 and {_has('text', WORDS)}), l as ({_LINES})
    select page_id, regexp_replace(text, '^\\d+[.、]\\s*', '') as title, case when regexp_matches(href, '^https?:') then href else regexp_replace(url, '/+$', '') || '/' || regexp_replace(href, '^/+', '') end as source_url, 0 as n_body, 'anchor' as kind
        from a qualify row_number() over (partition by page_id order by pos) <= 30
    union all select page_id, substr(coalesce(t, ''), 1, 60), url, length(substr(coalesce(body, ''), 1, 2000)), 'page' from pages left join (select page_id, arg_min(text, pos) as t, string_agg(text, ' ' order by pos) as body from l group by 1) using (page_id)
        where page_id not in (select page_id from a)""")
def page_generic_postings(t: Tables):
    out = E.page_generic_postings(_events(t), _pages(t), WORDS)
    return out.select("page_id", "title", "source_url", F.length("body").cast("long").alias("n_body"), "kind")


_PART = "trim(regexp_extract(body, '(?s)(?:{h})[：:]?\\s*(.*?)(?:[A]+、|\\n?$)', 1))"


@query(f"""select id, t as title, length(case when d = '' and c = '' then substr(body, 1, 2000) else d || ' ' || c end) as n_body from (select id, body, {_PART.format(h='The')} as t, {_PART.format(h='In|Der')} as d, {_PART.format(h='On|Le')} as c from postings_text)""")
def page_notice_sections(t: Tables):
    s = E.page_notice_sections(F.col("body"), "The", "In|Der", ("On", "Le"), "A")
    return t.postings_text.select("id", s.alias("s")).select("id", "s.title", F.length("s.body").cast("long").alias("n_body"))


def _lines(t: Tables):
    return _events(t).filter("kind = 'line'").select("page_id", "pos", "text")


_DAY = "regexp_extract(text, '(\\d{4}[-/年]\\d{1,2}[-/月]\\d{1,2}日?)', 1)"
_TITLED = f"{_has('text', WORDS)} and length(text) > 6 and length(text) < 60"


@query(f"""with l as ({_LINES}), h as (select page_id, coalesce(min(case when {_TITLED} then pos end), min(pos)) as top, arg_min({_DAY}, case when {_DAY} <> '' then pos end) as day from l group by 1 having count(*) >= 3),
    s as (select page_id, min(pos) as stop from l join h using (page_id) where pos > top and {_has('text', ('mail', 'tel'))} group by 1)
    select page_id, max(case when pos = top then text end) as title, coalesce(replace(regexp_replace(any_value(day), '[年月]', '-', 'g'), '日', ''), '') as posted_at,
        coalesce(string_agg(text, chr(10) order by pos) filter (pos > top and (stop is null or pos < stop)), '') as body from l join h using (page_id) left join s using (page_id) group by 1""")
def page_article_lines(t: Tables):
    return E.page_article_lines(_lines(t), WORDS, ("mail", "tel"), 3)


@query("""select id as page_id, 'u#job-' || i as source_url, case when length(trim(p[i + 1])) < 10 then trim('（一）' || p[i + 1]) else trim(p[i + 1]) end as body
    from (select id, p, unnest(range(1, len(p))) as i from (select id, string_split(regexp_replace(body, '\\. ', '（一）', 'g'), '（一）') as p from postings_text))""")
def page_split_announcement(t: Tables):
    text = F.concat(F.lit("招聘岗位"), F.regexp_replace("body", r"\. ", "（一）"), F.lit("一、"))
    return E.page_split_announcement(t.postings_text.select(F.col("id").alias("page_id"), F.lit("u").alias("url"), text.alias("text")))


@query("""with d as (select l_orderkey as page_id, l_partkey % 3 as position, 'dep' || l_suppkey as department from lineitem), e as (select page_id, position, list_slice(list_sort(list(distinct department)), 1, 5) as x from d group by 1, 2)
    select page_id, position, array_to_string(x, '、') as departments, '#pos-' || row_number() over (partition by page_id order by position) as part from e""")
def page_position_departments(t: Tables):
    rows = t.read("lineitem").select(F.col("l_orderkey").alias("page_id"), (F.col("l_partkey") % 3).alias("position"), F.format_string("dep%d", "l_suppkey").alias("department"))
    return E.page_position_departments(rows)


_FILE = "lower(regexp_replace(link, '[?#].*$', ''))"


@query(f"""select page_id, row_number() over (partition by page_id order by pos) as n, link as url, case when trim(text) <> '' then trim(text) else regexp_extract(link, '([^/?#]*)(?:[?#].*)?$', 1) end as name, regexp_extract({_FILE}, '\\.([a-z]+)$', 1) as extension
    from (select page_id, link, min(pos) as pos, arg_min(text, pos) as text from (select *, {_ABS} as link from (select * replace (case when page_id % 3 = 0 then href || '.PDF?x=1' else href end as href) from ({_ANCHORS}))) where regexp_matches({_FILE}, '\\.(xlsx|xls|pdf)$') group by 1, 2)""")
def page_attachment_links(t: Tables):
    ev = _events(t).withColumn("href", F.when(F.col("page_id") % 3 == 0, F.concat("href", F.lit(".PDF?x=1"))).otherwise(F.col("href")))
    return _ranked(E.page_attachment_links(ev, _pages(t)))


@query("""select id, url, case when not coalesce(r, false) and r is not null then 'failed' when r then 'parsed' else 'discovered' end as status, case when r = false then 'http ' || id % 500 end as error
    from (select id, attachment_url as url, case id % 3 when 0 then true when 1 then false end as r from jobs where attachment_url is not null)""")
def attachment_status(t: Tables):
    a = t.jobs.filter("attachment_url is not null").select("id", F.col("attachment_url").alias("url"))
    got = a.filter("id % 3 < 2").select("url", (F.col("id") % 3 == 0).alias("ok"), F.when(F.col("id") % 3 == 1, F.concat(F.lit("http "), (F.col("id") % 500).cast("string"))).alias("error"))
    return E.attachment_status(a, got)


_HEAD = f"""select attachment_url, sheet, coalesce(min(case when row_index <= 10 and len(list_filter(cells, lambda c: trim(c) <> '')) >= 2 and len(list_filter(cells, lambda c: contains(c, 'Title') or contains(c, 'Degree'))) > 0 then row_index end), 1) as header_row from ({_CELLS}) group by 1, 2"""
_HEADED = f"select h.attachment_url, h.sheet, header_row, cells as headers from ({_HEAD}) h join ({_CELLS}) c on c.attachment_url = h.attachment_url and c.sheet = h.sheet and c.row_index = header_row"
_ROWS = f"""select c.attachment_url, c.sheet, row_index, list_filter(list_zip(list_transform(headers, lambda x: trim(x)), list_transform(cells, lambda x: trim(x))), lambda p: p[1] <> '' and p[2] <> '') as pairs
    from ({_CELLS}) c join ({_HEADED}) h on c.attachment_url = h.attachment_url and c.sheet = h.sheet where row_index > header_row"""
_RAW = "array_to_string(list_transform(pairs, lambda p: p[1] || '：' || p[2]), '；')"


def _headers(t: Tables):
    return E.grid_header(_cells(t), ("Title", "Degree"))


@query(f"select attachment_url, sheet, header_row, array_to_string(list_transform(headers, lambda x: trim(x)), '|') as headers from ({_HEADED})")
def grid_header(t: Tables):
    return _headers(t).select("attachment_url", "sheet", F.col("header_row").cast("long").alias("header_row"), F.array_join("headers", "|").alias("headers"))


@query(f"select attachment_url, sheet, row_index, {_RAW} as raw_text from ({_ROWS}) where len(pairs) > 0")
def grid_rows(t: Tables):
    return E.grid_rows(_cells(t), _headers(t)).select("attachment_url", "sheet", F.col("row_index").cast("long").alias("row_index"), "raw_text")


def _grid(t: Tables):
    return E.grid_postings(E.grid_rows(_cells(t), _headers(t)), {"title": ("Title", "Post"), "unit": ("Unit",), "education": ("Deg",)}, "posting")


_PICK = "coalesce(list_filter(pairs, lambda p: contains(p[1], '{n}'))[1][2], '{d}')"


@query(f"select attachment_url, sheet, row_index, {_PICK.format(n='Title', d='posting')} as title, {_PICK.format(n='Unit', d='')} as unit, {_PICK.format(n='Deg', d='')} as education, attachment_url || '#' || sheet || '-' || row_index as source_url from ({_ROWS}) where len(pairs) > 0")
def grid_postings(t: Tables):
    return _grid(t).drop("raw_text").withColumn("row_index", F.col("row_index").cast("long"))


@query(f"""select page_id, regexp_extract(html, '<h1>([^<]*)', 1) as title, url as source_url, 'site' as parser_name, coalesce(n, 0) as n_attachments from pages left join (select regexp_extract(attachment_url, '(\\d+)', 1)::bigint as page_id, count(distinct sheet) as n from ({_CELLS}) group by 1) using (page_id)
    union all select page_id, {_PICK.format(n='Title', d='posting')}, attachment_url || '#' || sheet || '-' || row_index, 'site-xlsx-v1', 0 from (select *, regexp_extract(attachment_url, '(\\d+)', 1)::bigint as page_id from ({_ROWS})) where len(pairs) > 0 and page_id in (select page_id from pages)""")
def notice_with_attachments(t: Tables):
    page = F.regexp_extract("attachment_url", r"(\d+)", 1).cast("long")
    notices = _pages(t).select("page_id", F.regexp_extract("html", "<h1>([^<]*)", 1).alias("title"), F.col("url").alias("source_url"), F.lit("site").alias("parser_name"))
    grid = _grid(t).select(page.alias("page_id"), "title", "source_url")
    states = _cells(t).select(page.alias("page_id"), F.col("sheet").alias("name"), F.lit("parsed").alias("status")).distinct()
    out = E.notice_with_attachments(notices, grid, states)
    return out.select("page_id", "title", "source_url", "parser_name", F.coalesce(F.size("attachments"), F.lit(0)).cast("long").alias("n_attachments"))


@query(f"""select page_id, "rank", link as url from (select page_id, link, row_number() over (partition by page_id order by min(pos)) as "rank" from (select *, {_ABS} as link from ({_ANCHORS})) where trim(href) <> '' and not starts_with(lower(href), 'data:')
    and not regexp_matches(lower(href), 'icon|logo|banner|\\.gif') group by 1, 2) where "rank" <= 4""")
def page_images(t: Tables):
    ev = _events(t).withColumns({"kind": F.when(F.col("kind") == "a", "img").otherwise(F.col("kind"))})
    return E.page_images(ev, _pages(t))


_RAWED = f"""select *, {_NORM.format(c="title || chr(10) || body")} as raw from (select *, title || ' ' || body as t from postings_text)"""
_ASKED = f"select *, {_FIT} as k from (select *, {_NORM.format(c='body')} as n from ({_RAWED}))"
_SURE = f"least(0.55::double + case when title <> '' then 0.1::double else 0 end + case when length(raw) > 80 then 0.1::double else 0 end + case when {_has('raw', SYNTH.education)} then 0.1::double else 0 end + case when len({_ALL}) > 0 then 0.1::double else 0 end, 0.95)"


@query(f"""with a as ({_ASKED}), r as (select id, title, raw, {_FIT} as k, n from (select id, title, raw, raw as n from a)), c as (select id, {_SURE} as confidence from r)
    select id, {_CAT} as job_category, {_EDU.replace('(t,', '(raw,')} as education, coalesce(nullif(array_to_string(list_filter({_q(SYNTH.professions)}, lambda w: contains(raw, w)), '、'), ''), 'any') as profession, array_to_string(list_sort(list_distinct({_TAGS})), '|') as tags, sha256(raw) as source_text_hash, confidence,
    length(case when len({_ALL}) > 0 then array_to_string({_ALL}, '；') else body end) as n_requirements from (select *, {_SCORES} from a) join c using (id)""")
def assemble_posting(t: Tables):
    out = E.assemble_posting(t.postings_text.withColumn("institution_type", F.col("institution")), SYNTH, "duties: ", "needs")
    return out.select("id", "job_category", "education", "profession", F.array_join("tags", "|").alias("tags"), "source_text_hash", "confidence", F.length("requirements").cast("long").alias("n_requirements"))


# streams: the same table in several micro-batches; what they add, put together, must equal the batch result
def _landed(t: Tables, rows, slice_of: str, folder: str) -> list:
    """The slices of rows, each a table of its own."""
    rows.withColumn("_slice", F.expr(slice_of)).write.partitionBy("_slice").parquet(f"{folder}/landed")
    landed = t.spark.read.parquet(f"{folder}/landed")
    numbers = sorted(n for (n,) in landed.select("_slice").distinct().collect())  # a few periods
    return [landed.filter(F.col("_slice") == n).select(rows.columns) for n in numbers]


def _fed(t: Tables, rows, slice_of: str, name: str, start, late: bool = False) -> str:
    """Lands the slices of rows one after the other and runs the stream over each, as arrivals would; start(source, checkpoint, target).

    late: the second slice comes first, and every slice brings rows of the one before once more.
    """
    folder = shared_folder(t.spark, name)
    slices = _landed(t, rows, slice_of, folder)
    if late:
        slices = [*slices[1:2], *slices[:1], *slices[2:]]
    for k, part in enumerate(slices):
        part.write.mode("append").parquet(f"{folder}/in")
        if late and k:
            slices[k - 1].write.mode("append").parquet(f"{folder}/in")
        source = t.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        start(source, f"{folder}/checkpoint", f"{folder}/out").awaitTermination()
    return f"{folder}/out"


_PERIOD = "cast(floor(year(fetched_at) / 3) as int)"


@query(q_ingest._CUR)
def stream_posting_upsert(t: Tables):
    out = _fed(t, t.observations, _PERIOD, "postings", streams.stream_posting_upsert, late=True)
    return streams.current(t.spark, out).withColumn("fetched_at", F.unix_timestamp("fetched_at"))


@query(f"select *, case when consecutive_failures = 0 then 'success' when consecutive_failures >= 2 then 'review' else 'failed' end as status from ({q_ingest._HEALTH})")
def stream_source_health(t: Tables):
    out = _fed(t, t.outcomes, "cast(floor(run_id / 8) as int)", "health", streams.stream_source_health, late=True)
    return streams.health(t.spark, out)


#: A period's pushes: of what is new since the checkpoint the newest hundred; the checkpoint of the next push is the period's last posting.
_PUSHES = f"""with h as (select *, coalesce(last_pushed_at, last_checked_at) as first_since, year(fetched_at) // 3 as period from ({q_people._HITS})),
    top as (select * from (select *, row_number() over (partition by id, period order by fetched_at desc, job_id desc) as place from h where fetched_at > first_since) where place <= 100 and {q_people._WORD}),
    push as (select id, period, any_value(first_since) as since, max(fetched_at) as newest_at, count(*) as job_count, list_slice(list(title order by fetched_at desc, job_id desc), 1, 3) as shown from top group by 1, 2)"""


@query(_PUSHES + """ select id as subscription_id, epoch(since)::bigint as since, epoch(newest_at)::bigint as newest_at, job_count,
    array_to_string(shown, '、') || case when job_count > 3 then ' 等 ' || job_count || ' 条' else '' end as summary from push""")
def stream_sub_scan(t: Tables):
    """The slices come out of order and twice; each posting is pushed once."""
    watching = t.keep(_watching(t), "watching")  # read by every batch
    out = _fed(t, t.jobs, _PERIOD, "scan", lambda source, checkpoint, target: streams.stream_sub_scan(source, watching, checkpoint, target, "10000 days"), late=True)
    notes = streams.stored(t.spark, out, "notifications")
    return notes.select("subscription_id", F.unix_timestamp("since").alias("since"), F.unix_timestamp("newest_at").alias("newest_at"), "job_count", "summary")


@query(_PUSHES + " select id as subscription_id, count(*) as pushes, 0::bigint as duplicates, sum(job_count)::bigint as jobs from push group by 1")
def sub_no_duplicate_push(t: Tables):
    """Pushes of a subscription, and how many postings were pushed to it twice, after two scans at once for each arrival."""
    watching, folder = t.keep(_watching(t), "watching"), shared_folder(t.spark, "overlapping")
    here = None
    for part in _landed(t, t.jobs, _PERIOD, folder):
        here = part if here is None else here.unionByName(part)
        with ThreadPoolExecutor(2) as pool:
            for scan in [pool.submit(streams.scan_and_push, watching, here, f"{folder}/out") for _ in range(2)]:
                scan.result()
    notes = t.spark.read.parquet(f"{folder}/out")
    twice = notes.select("subscription_id", F.explode("job_ids").alias("job_id")).groupBy("subscription_id").agg((F.count(F.lit(1)) - F.countDistinct("job_id")).alias("duplicates"))
    return notes.groupBy("subscription_id").agg(F.count(F.lit(1)).alias("pushes"), F.sum("job_count").alias("jobs")).join(twice, "subscription_id")
