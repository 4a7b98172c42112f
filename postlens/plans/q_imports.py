"""Bulk resume import and profiles in long form, with the rules once more as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import imports as M
from postlens.operators import profiles
from postlens.plans.q_text import _NORM, _has, _q
from postlens.plans.registry import query
from postlens.sources.bindings import Tables

# The SQL side. DuckDB's patterns have no look-ahead: what must not follow is matched as another character or the end.
_SEP = r"\s*[-–—~～至到]+\s*"
_Y, _YG = rf"(\d{{4}}){_SEP}(至今|现在|(\d{{4}}))", 3
_M, _MG = rf"(\d{{4}})[年./\-](\d{{1,2}})[月]?{_SEP}(至今|现在|(\d{{4}})[年./\-](\d{{1,2}})[月]?)", 5
_YE = "(?:[^年月]|$)"


def _period(c: str) -> str:
    """period_start, period_end, rest of column c, as time_range gives them."""
    x = lambda p, g: f"regexp_extract({c}, '{p}', {g})"
    years, months = f"regexp_matches({c}, '{_Y}{_YE}')", f"regexp_matches({c}, '{_M}')"
    is_open = lambda e: f"{e} in ('至今', '现在')"
    y2, m3 = x(_Y + _YE, 2), x(_M, 3)
    before = lambda p: f"regexp_extract({c}, '(?s)^(.*?){p}', 1)"
    cut_y = _NORM.format(c=f"({before(_Y + _YE)} || ' ' || regexp_extract({c}, '(?s)^.*?{_Y}((?:[^年月].*)?)$', {_YG + 1}))")
    cut_m = _NORM.format(c=f"({before(_M)} || ' ' || regexp_extract({c}, '(?s)^.*?{_M}(.*)$', {_MG + 1}))")
    return f"""case when {years} then {x(_Y + _YE, 1)} when {months} then {x(_M, 1)} || '.' || {x(_M, 2)} else '' end as period_start,
        case when {years} then case when {is_open(y2)} then '至今' else {x(_Y + _YE, 3)} end when {months} then case when {is_open(m3)} then '至今' else {x(_M, 4)} || '.' || {x(_M, 5)} end else '' end as period_end,
        case when {years} then {cut_y} when {months} then {cut_m} else {c} end as rest"""


def _in(c: str, words) -> str:
    return f"{c} in ({', '.join(repr(w) for w in words)})"


_COLLECTION = "case " + " ".join(f"when {_in('{c}', names)} then '{k}'" for k, names in M.ALIASES.items()) + " end"
_BARE = r"regexp_replace({c}, '^[\s\d一二三四五六七八九十、.．()（）\[\]【】*#:：\-—]+|[\s:：、.．*#\-—]+$', '', 'g')"
_HEAD_PATTERNS = (r"^[一二三四五六七八九十]+[、.]?\s*(.+)$", r"^\d{{1,2}}[、.)）]\s*(.+)$", r"^【(.+?)】$", r"^#+\s*(.+)$")


def _heading(c: str) -> str:
    t = f"trim({c})"
    bare = _BARE.replace("{c}", t)
    named = " ".join(f"when regexp_matches({t}, '{p}') then " + _NORM.format(c=f"regexp_extract({t}, '{p}', 1)") for p in (p.replace("{{", "{").replace("}}", "}") for p in _HEAD_PATTERNS))
    return f"case when {t} <> '' and length({t}) <= 20 then case {named} when length({bare}) between 2 and 12 then {bare} end end"


_STRIP = r"trim(regexp_replace({c}, '^[•·●◦▪‣*\-–—]+\s*|^\d{1,2}[.、)）]\s*', ''))"
_W = "over (partition by doc_id order by line_no rows unbounded preceding)"
_GROUPS = f"""select doc_id, line_no, grp, case when bullet and not opens then {_STRIP.replace('{c}', 'text')} else text end as text from (select *, (sum(opens::int) {_W})::bigint as grp from (
    select *, text <> '' and (not bullet or coalesce(lag(text) over (partition by doc_id order by line_no), '') = '') as opens from (
    select *, regexp_matches(text, '^[•·●◦▪‣*\\-–—]') as bullet from (select doc_id, line_no, {_NORM.format(c='text')} as text from resume_lines)))) where text <> ''"""
_YEAR_HEAD = r"regexp_matches(head, '^(?:19|20)\d{2}(?:[年./-]\d{1,2})?')"
_BLOCKS = f"""with g as materialized (select doc_id, grp, list(text order by line_no) as lines from ({_GROUPS}) group by 1, 2),
    h as (select *, lines[1] as head, case when len(lines) = 1 then {_heading('lines[1]')} end as heading from g), s as (select *, {_COLLECTION.replace('{c}', 'heading')} as section from h),
    n as (select *, last_value(section ignore nulls) over w as hint, count(section) over w as part from s window w as (partition by doc_id order by grp rows unbounded preceding)),
    p as (select *, {_period('head')} from n where section is null),
    b as (select *, row_number() over (partition by doc_id, part order by grp) = 1 or {_YEAR_HEAD} or (period_start <> '' and period_end <> '' and starts_with(head, substr(period_start, 1, 4)))
        or coalesce({_in('hint', M.PER_LINE)}, false) or regexp_matches(head, '{M.STANDALONE}') as starts from p),
    k as (select *, (sum(starts::int) over (partition by doc_id order by grp rows unbounded preceding))::bigint as block from b)
    select doc_id, block, any_value(hint) as hint, array_to_string(flatten(list(lines order by grp)), chr(10)) as text from k group by 1, 2"""
_CLAUSES = "list_filter(string_split_regex(text, '[，,；;。\\n]'), lambda c: trim(c) <> '')"
_SAYS = "regexp_matches(text, '{p}')"
_says = lambda p: _SAYS.replace("{p}", p)
_EDUC, _PROJ = f"(h = 'education' or ({_has('text', M.SCHOOLS)} and {_says(M.DEGREE)}))", f"(h = 'projects' or {_says('项目|课题|队列|平台|基金')})"
_IS = {
    "experiences": f"h = 'experiences' or (not {_EDUC} and not {_PROJ} and {_has('text', M.ORGS)} and {_has('text', M.ROLES)})", "education": _EDUC, "projects": _PROJ,
    "publications": f"h = 'publications' or {_says('论文|发表|期刊|doi|DOI|《[^》]+》')}", "teaching": f"h = 'teaching' or {_says('教学|授课|带教|助教|课程')}",
    "awards": f"h = 'awards' or {_says(M.AWARD + '|获奖|奖学金|荣誉')}",
    "certificates": f"len(list_filter({_CLAUSES}, lambda c: not regexp_matches(c, '{M.NEGATED}') and (h = 'certificates' or regexp_matches(c, '{M.CERTIFICATE}')))) > 0",
    "languages": f"h = 'languages' or ({_says(M.LANGUAGE)} and {_says(M.LANGUAGE_LEVEL)})",
}
_CLASSES = "list_filter([" + ", ".join(f"case when {_IS[c]} then '{c}' end" for c in M.PRIORITY) + "], lambda x: x is not null)"
_CLASSED = f"select *, {_CLASSES} as collections from (select *, coalesce(hint, '') as h from ({{b}}))"
# a word boundary knows all letters in Spark, ASCII alone in DuckDB
_WORD_R, _BOUND_R = r"\bR\b", r"(^|[^\p{L}\p{N}_])R($|[^\p{L}\p{N}_])"
_SKILLED = f"list_filter([" + ", ".join(f"case when len(list_filter(kept, lambda c: regexp_matches(c, '{p.replace(_WORD_R, _BOUND_R)}'))) > 0 then '{name}' end" for name, p in M.SKILLS) + "], lambda x: x is not null)"
_KEPT = f"list_filter({_CLAUSES}, lambda c: not regexp_matches(c, '{M.NEGATED}'))"
_LABELS = "^(学校|院校|毕业院校|专业|学历|学位|工作单位|任职单位|单位|岗位|职位|职务)[：:](.+)$"
_TOKS = f"flatten(list_transform(list_filter(string_split_regex(rest, '[\\s,，;；、|/]+'), lambda t: t <> ''), lambda t: case when regexp_matches(t, '{_LABELS}') then [regexp_extract(t, '{_LABELS}', 1), regexp_extract(t, '{_LABELS}', 2)] else [t] end))"
_UNLABELLED = "regexp_replace(t, '[：:]+$', '')"


def _labeled(labels) -> str:
    at = f"list_position(list_transform(toks, lambda t: {_in(_UNLABELLED, labels)}), true)"
    return f"case when {at} > 0 then toks[{at} + 1] end"


def _token(cond: str) -> str:
    return f"list_filter(toks, lambda t: {cond})[1]"


def _token_with(words, but=()) -> str:
    return _token(_has("t", words).replace("lambda w", "lambda v").replace("(t, w)", "(t, v)") + (f" and not {_in(_UNLABELLED, but)}" if but else ""))


_h = lambda words: _has("t", words).replace("lambda w", "lambda v").replace("(t, w)", "(t, v)")
_YR = r"regexp_matches(t, '^(?:19|20)\d{2}$')"
_PLAIN = _token(f"not {_YR} and not {_h(M.ISSUERS)}")
_NAME = f"""case collection when 'education' then coalesce({_labeled(('学校', '院校', '毕业院校'))}, {_token_with(M.SCHOOLS, M.EDU_LABELS)}) when 'experiences' then coalesce({_labeled(M.ORG_LABELS)}, {_token_with(M.ORGS, M.ORG_LABELS + M.ROLE_LABELS)})
    when 'projects' then coalesce({_token_with(M.PROJECT_NAMES)}, toks[1], rest) when 'publications' then text when 'languages' then coalesce(nullif(regexp_extract(text, '({M.LANGUAGE})', 1), ''), text)
    when 'teaching' then {_token(_h(('课', '学')) + ' and not ' + _h((*M.SCHOOLS, '医院')))} else coalesce({_PLAIN}, text) end"""
_ROLE = f"""case collection when 'education' then regexp_extract(rest, '({M.DEGREE})', 1) when 'experiences' then coalesce({_labeled(M.ROLE_LABELS)}, {_token(_h(M.ROLES) + ' and t is distinct from raw_name')})
    when 'projects' then {_token_with(M.PROJECT_ROLES)} when 'publications' then regexp_extract(text, '《([^《》\\r\\n]{{1,500}})》', 1) when 'languages' then regexp_extract(text, '({M.LANGUAGE_LEVEL})', 1)
    when 'teaching' then {_token_with(('主讲', '助教', '带教', '讲师', '授课'))} when 'awards' then regexp_extract(text, '({M.AWARD})', 1) else {_token_with(M.ISSUERS)} end"""


def _confidence(name: str, role: str, highlight: str) -> str:
    """Of columns text, hint, collection, whole_start, whole_end; the terms are added in the operator's order."""
    always = "collection in ('publications', 'teaching', 'awards', 'certificates', 'skills')"
    strong = f"({always} or collection in ('projects', 'languages') or (collection = 'experiences' and {name} <> '' and {role} <> ''))"
    missing = f"((collection in ('education', 'experiences', 'languages') and {name} = '' and {role} = '') or (collection in ('projects', 'certificates', 'skills') and {name} = ''))"
    terms = (("coalesce(hint = collection, false)", "0.15"), ("whole_start <> '' and whole_end <> ''", "0.10"), (f"{name} <> ''", "0.15"), (f"{always} or {role} <> ''", "0.10"), (highlight, "0.05"), (strong, "0.15"), (f"{missing} or length(trim(text)) < 4", "-0.10"))
    total = "0.4::double" + "".join(f" + case when {hit} then {share}::double else 0::double end" for hit, share in terms)
    return f"round_even(greatest(0::double, least(1::double, {total})), 2)"


_WHOLE = _period("text").replace("period_start", "whole_start").replace("period_end", "whole_end").replace("as rest", "as whole_rest")
_FACTS = f"""with b as materialized ({_BLOCKS}), c as (select *, unnest(collections) as collection from ({_CLASSED.replace('{b}', 'select * from b')})), w as (select *, {_WHOLE} from c), p as (select *, {_period('head')} from (select *, split_part(text, chr(10), 1) as head from w)),
    t as (select *, {_TOKS} as toks from p), n as (select *, {_NAME} as raw_name from t), r as (select *, coalesce(raw_name, '') as name, coalesce({_ROLE}, '') as role, regexp_extract(text, '((?:19|20)\\d{{2}})', 1) as "year" from n)
    select doc_id, block, hint, text, collection, name, role, "year", period_start as "start", period_end as "end", {_confidence('name', 'role', "contains(text, chr(10)) and collection in ('education', 'experiences', 'projects')")} as confidence from r"""
_PLACE = f"list_position({_q(M.PRIORITY)}, collection)"
_PRIM = f"select * from ({_FACTS}) qualify row_number() over (partition by doc_id, block order by confidence desc, {_PLACE}) = 1"
_ROUTE = f"case when confidence >= {M.AUTO} then 'auto' when confidence >= {M.REVIEW} then 'review' else 'drop' end"
_BAD = "|".join((*M.ORGS, *M.ROLES, *M.SCHOOLS)) + "|" + M.DEGREE
_HEADS = [a for xs in M.ALIASES.values() for a in xs]
_LIKELY = f"list_filter(string_split(text, chr(10)), lambda t: regexp_matches(t, '^[一-鿿]{{2,4}}$') and not {_in('t', (*_HEADS, *M.NOT_NAMES))} and not regexp_matches(t, '{_BAD}'))[1]"
_BASICS = f"""select doc_id, arg_max(phone, case when phone <> '' then block end) as phone, arg_max(email, case when email <> '' then block end) as email, coalesce(arg_min(label, case when label <> '' then block end), arg_min(likely, case when likely is not null and block <= 3 then block end)) as name,
    max(case when phone <> '' then block end) as phone_block, max(case when email <> '' then block end) as email_block, coalesce(min(case when label <> '' then block end), min(case when likely is not null and block <= 3 then block end)) as name_block
    from (select doc_id, block, regexp_extract(text, '(1[3-9]\\d{{9}})', 1) as phone, regexp_extract(text, '([\\w.+-]+@[\\w-]+\\.[\\w.-]+)', 1) as email, regexp_extract(text, '(?:姓名|名字|称谓)[:：\\s]\\s*([一-鿿]{{2,4}})(?:[^一-鿿]|$)', 1) as label, {_LIKELY} as likely from bl) group by 1"""
_LEFT = f"""with bl as materialized ({_BLOCKS}), basics as ({_BASICS}), routed as (select * from ({_PRIM}) where {_ROUTE} <> 'drop'),
    used as (select doc_id, text from routed union select bl.doc_id, bl.text from (select doc_id, unnest([phone_block, email_block, name_block]) as block from basics) x join bl using (doc_id, block))
    select bl.* from bl anti join used using (doc_id, text)"""



def _blocks(t: Tables, often: bool = False):
    """Blocks of resume lines; a query that uses them several times keeps them as a table."""
    blocks = M.line_blocks(t.resume_lines)
    return t.keep(blocks, "blocks") if often else blocks


def _primary(blocks):
    return M.fact_primary(M.facts(blocks))


def _routed(blocks):
    return _primary(blocks).filter(M.fact_routing(F.col("confidence")) != "drop")


def _fields(df):
    return df.select("doc_id", "block", "collection", "confidence", "f.name", "f.role", "f.year", "f.start", "f.end")


@query(f"select doc_id, line_no, period_start as \"start\", period_end as \"end\", length(rest) as n_rest from (select *, {_period('text')} from resume_lines) where period_start <> ''")
def time_range(t: Tables):
    r = M.time_range(F.col("text"))
    return t.resume_lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), r["start"].alias("start"), r["end"].alias("end"), F.length(r["rest"]).cast("long").alias("n_rest")).filter("start <> ''")


@query(f"select doc_id, max(grp) as groups, count(*) as lines from ({_GROUPS}) group by 1")
def line_groups(t: Tables):
    return M.line_groups(t.resume_lines).groupBy("doc_id").agg(F.max("group").alias("groups"), F.count(F.lit(1)).alias("lines"))


@query(f"select doc_id, line_no, heading, {_COLLECTION.replace('{c}', 'heading')} as collection from (select *, {_heading('text')} as heading from resume_lines) where heading is not null")
def line_heading(t: Tables):
    h = M.line_heading(F.col("text"))
    return t.resume_lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), h.alias("heading"), M.heading_collection(h).alias("collection")).filter("heading is not null")


@query(f"select doc_id, block, hint, length(text) as n from ({_BLOCKS})")
def line_blocks(t: Tables):
    return _blocks(t).select("doc_id", "block", "hint", F.length("text").cast("long").alias("n"))


@query(f"select doc_id, block, array_to_string(collections, '|') as collections from ({_CLASSED.replace('{b}', _BLOCKS)})")
def block_classify(t: Tables):
    return _blocks(t).select("doc_id", "block", F.array_join(M.block_classify(F.col("text"), F.col("hint")), "|").alias("collections"))


@query(f'select doc_id, block, collection, confidence, name, role, "year", "start", "end" from ({_FACTS})')
def block_fields(t: Tables):
    return _fields(M.facts(_blocks(t)))


@query(f"select * from (select doc_id, block, array_to_string({_SKILLED}, '|') as skills from (select *, {_KEPT} as kept from ({_BLOCKS}))) where skills <> ''")
def block_skills(t: Tables):
    return _blocks(t).select("doc_id", "block", F.array_join(M.block_skills(F.col("text")), "|").alias("skills")).filter("skills <> ''")


@query(f"select doc_id, block, collection, confidence from ({_FACTS})")
def fact_confidence(t: Tables):
    return M.facts(_blocks(t)).select("doc_id", "block", "collection", "confidence")


@query(f"""with prim as materialized ({_PRIM}), bl as ({_BLOCKS}),
    sk as (select bl.*, 'skills' as collection, {_WHOLE} from bl left join (select doc_id, block, true as fact from prim) f using (doc_id, block) where hint = 'skills' or regexp_matches(text, '熟悉|掌握|技能|使用|运用') or fact),
    named as (select *, unnest({_SKILLED}) as name from (select *, {_KEPT} as kept from sk))
    select doc_id, block, collection, name, confidence from prim union all select doc_id, block, collection, name, {_confidence('name', 'name', 'false')} from named""")
def fact_primary(t: Tables):
    blocks = _blocks(t, often=True)
    primary = t.keep(_primary(blocks), "facts")
    skills = M.skill_facts(blocks, primary).select("doc_id", "block", "collection", "name", "confidence")
    return primary.select("doc_id", "block", "collection", "f.name", "confidence").unionByName(skills)


@query(f"select collection, {_ROUTE} as route, count(*) as n from ({_PRIM}) group by 1, 2")
def fact_routing(t: Tables):
    return _primary(_blocks(t)).groupBy("collection", M.fact_routing(F.col("confidence")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with bl as ({_BLOCKS}) {_BASICS}")
def doc_basics(t: Tables):
    return M.doc_basics(_blocks(t))


@query(f"select doc_id, block, length(text) as n from ({_LEFT})")
def doc_unassigned(t: Tables):
    b = _blocks(t, often=True)
    return M.doc_unassigned(b, _routed(b), M.doc_basics(b)).select("doc_id", "block", F.length("text").cast("long").alias("n"))


@query(f'''select doc_id, block, collection, confidence, name, role, "year", "start", "end" from ({_PRIM}) where {_ROUTE} <> 'drop' qualify row_number() over (partition by doc_id, collection, name, role, "year", "start", "end" order by block) = 1''')
def doc_dedupe(t: Tables):
    return _fields(M.doc_dedupe(_routed(_blocks(t))))


@query(f"""select doc_id, blocks, round_even((texts - coalesce(n_left, 0)) / blocks, 2) as quality from (select doc_id, count(*) as blocks, count(distinct text) as texts from ({_BLOCKS}) group by 1)
    left join (select doc_id, count(distinct text) as n_left from ({_LEFT}) group by 1) using (doc_id)""")
def doc_quality(t: Tables):
    b = _blocks(t, often=True)
    return M.doc_quality(b, M.doc_unassigned(b, _routed(b), M.doc_basics(b)))


@query(f"""with t as (select doc_id, line_no, {_NORM.format(c='text')} as text from resume_lines), s as (select *, case when text <> '' and length(text) <= 12 then {_COLLECTION.replace('{c}', _BARE.replace('{c}', 'text'))} end as own, {_STRIP.replace('{c}', 'text')} as body from t),
    m as (select *, last_value(own ignore nulls) {_W} as section, sum((own is not null or body = '' or regexp_matches(body, '^\\d{{4}}'))::int) {_W} as part from s)
    select doc_id, section, count(distinct part) as parts from m where own is null and body <> '' group by 1, 2""")
def line_sections_legacy(t: Tables):
    return M.line_sections_legacy(t.resume_lines).groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("parts"))


@query("""with l as (select doc_id, unnest(range(1, len(x) + 1)) - 1 as line_no, trim(unnest(x)) as s from (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from documents))
    select case when s = '' then 'blank' when regexp_matches(s, '^#{1,6}\\s+') then 'heading' when regexp_matches(s, '^(?:[-*+]|\\d+[.)])\\s+') then 'bullet' else 'paragraph' end as kind, count(*) as n from l group by 1""")
def md_line_kinds(t: Tables):
    lines = t.read("documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "text"))
    return profiles.md_line_kinds(lines).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""with items as (select o_custkey as user_id, list(o_orderpriority order by o_orderkey) as items from orders where o_orderstatus <> 'P' group by 1), new as (select o_custkey as user_id, list(o_orderpriority order by o_orderpriority, o_orderkey) as n from orders where o_orderstatus = 'P' and o_orderkey % 2 = 0 group by 1)
    select i.user_id, case when i.user_id % 3 = 0 then 'imported' else c_name end as name, array_to_string(list_concat(items, coalesce(n, [])), '|') as items, coalesce(len(n), 0) as accepted from items i join customer on c_custkey = i.user_id left join new on new.user_id = i.user_id""")
def import_merge(t: Tables):
    o = t.read("orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("collection"), F.col("o_orderpriority").alias("text"), "o_orderstatus")
    own = o.filter("o_orderstatus <> 'P'").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda x: x["text"]).alias("items"))
    named = t.read("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    basics = named.select("user_id", F.when(F.col("user_id") % 3 == 0, "imported").otherwise("").alias("name"))
    candidates = o.filter("o_orderstatus = 'P'")
    out = profiles.import_merge(own.join(named, "user_id"), candidates, candidates.filter("item_id % 2 = 0").select("user_id", "item_id"), basics)
    return out.withColumn("items", F.array_join("items", "|"))


@query("""select c_custkey as user_id, 'education' as collection, 0 as idx, 'education-1' as field_id, c_name as label, c_name || case when c_custkey % 2 = 0 then ' 硕士' else '' end || ' 学历 学位 专业' as text from customer
    union all select c_custkey, 'publications', 0, 'publications-1', c_mktsegment, c_mktsegment || ' 发表论文 学术论文 科研成果' from customer""")
def fact_flatten(t: Tables):
    k = F.col("c_custkey")
    doc = F.to_json(F.struct(F.array(F.struct(F.col("c_name").alias("school"), F.when(k % 2 == 0, "硕士").alias("degree"), F.lit("2020").alias("start"))).alias("education"), F.array(F.struct(F.col("c_mktsegment").alias("title"), F.lit("2021").alias("year"))).alias("publications")))
    return profiles.fact_flatten(profiles.load_profiles(t.read("customer").select(k.alias("user_id"), doc.alias("data")))).withColumn("idx", F.col("idx").cast("long"))
