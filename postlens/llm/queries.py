"""The queries of this folder's operators, with production parameters, and their SQL where it exists."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, filter_audit, language, line_dedup, mixing, packing, sharding, simhash, structure, suffix_dedup, topk, toxicity
from .common import read_table

SHARDS = 24
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read_table(spark, sf_dir, "documents"), SHARDS)
    return placed.selectExpr("doc_id", "size", "text_crc32", "'bytes' as law", "shard", "slot", "cast(null as int) as grown_shard", "virtual_slot", "map_version")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(read_table(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(read_table(spark, sf_dir, "documents")).drop("text_md5")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).drop("rate")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(read_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(read_table(spark, sf_dir, "documents"), TOKENIZER))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_conversations(rows))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    return structure.summary(rows, *structure.repair(structure.damaged(rows)))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(*filter_audit.failure_masks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_SPACE = r"[\x20\x09-\x0D]"

SQL = {
    "op3_exact_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
            where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
        s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score from v q join v c on len(q.v) = len(c.v) and q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
        select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s qualify rank <= 10""",
    "op4_exact_dedup": rf"""
        with d as (select doc_id, length(coalesce(text, '')) as chars, regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g') as norm from documents),
        g as (select *, first_value(doc_id) over (partition by norm order by chars desc, doc_id) as keep_id, count(*) over (partition by norm) as group_size from d)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from g""",
    "op5_source_mixing": """
        with d as (select *, strlen(coalesce(text, '')) as bytes, coalesce(doc_id::varchar, 'text:' || md5(coalesce(text, ''))) as name from documents),
        s as (select source, sum(bytes) as size, sum(sum(bytes)) over () as total, count(*) over () as n from d group by source),
        r as (select source, case when size > 0 then total / n / size else 0 end as rate from s),
        p as (select source, rate, greatest(ceil(rate / 64), 1)::int as parts from r),
        t as (select source, parts, (select list(c order by k) from (
                select k, sum(p) over (order by k) as c from (
                    select k, case when rate > 0 then exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1)) else (k = 0)::int end as p from range(0, 600) as x(k)))) as cdf from p),
        u as (select d.*, list_sum(list_transform(range(0, parts), lambda part: len(list_filter(cdf, lambda c: c <=
                ('0x' || substr(md5('mix-1:' || case when part = 0 then '' else 'part:' end || name || case when part = 0 then '' else ':' || part end), 1, 13))::bigint / pow(2, 52)))))::int as n_copies
            from d join t on d.source is not distinct from t.source),
        c as (select u.*, unnest(range(0, n_copies))::int as copy from u)
        select doc_id, text, lang, source, n_chars, copy, n_copies,
            ('0x' || substr(md5('mix-1:order:' || name || ':' || copy), 1, 13))::bigint / pow(2, 52) as shuffle_key from c""",
    # a turn's brackets and tags take 20, 18, 16 or, with the role's name, 19 characters; each of \ < [ takes two
    "op9_chat_formatting": r"""
        with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -1, x, case x when 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]' from range(0, 2) as t(x)),
        f as (select *, length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')) + case role when 'assistant' then 20 when 'user' then 18 when 'system' then 16
            else 19 + length(role) + length(regexp_replace(role, '[^\\<\[\]]', '', 'g')) end as chars from r)
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
            coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
            sum(chars)::bigint as formatted_chars from f group by conv_id""",
    # forward: of each state the cheapest edits so far, row by row; n, s, u, a: nothing yet, after a system, user, assistant row
    "op11_structure_repair": rf"""
        with recursive k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint) as bytes from conversations),
        h as (select *, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 as fate from k),
        d as (select conv_id, turn, case when fate = 4 then 'user' else role end as role, case fate when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
                unnest(range(0, case fate when 3 then 2 else 1 end)) as again from h where fate <> 0),
        p as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos, case role when '' then ' ' else role[1:1] end as initial,
                regexp_extract(text, '([^\x20\x09-\x0D]){_SPACE}*\z', 1) as mark from d),
        f as (select *, case when mark = '' then 'blank' when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'duplicate' when mark not in ('.', '!', '?') then 'truncated' else '' end as fault,
                lag(initial) over (partition by conv_id order by pos) || initial as pair, chr(10) || role || ':' || text as line from p),
        g as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
                count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, count(*) as many from f group by conv_id),
        t as (select conv_id, 0::bigint as pos, [struct_pack(c := 0::bigint, a := '', r := ''), struct_pack(c := 1000000000::bigint, a := '', r := ''),
                struct_pack(c := 3::bigint, a := 'I', r := chr(10) || 'user:'), struct_pack(c := 6::bigint, a := 'II', r := chr(10) || 'user:' || chr(10) || 'assistant:')] as v from g
            union all
            select conv_id, pos, [n, s, u, least(a, struct_pack(c := u.c + 3, a := u.a || 'I', r := u.r || chr(10) || 'assistant:'))] from (
                select conv_id, pos, n, s, least(u, struct_pack(c := least(n, s, a).c + 3, a := least(n, s, a).a || 'I', r := least(n, s, a).r || chr(10) || 'user:')) as u, a from (
                    select t.conv_id, f.pos, struct_pack(c := v[1].c + 4, a := v[1].a || 'D', r := v[1].r) as n,
                        least(struct_pack(c := v[2].c + 4, a := v[2].a || 'D', r := v[2].r), struct_pack(c := v[1].c + more + case initial when 's' then 0 else 1000000000 end, a := v[1].a || 'K', r := v[1].r || line)) as s,
                        least(struct_pack(c := v[3].c + 4, a := v[3].a || 'D', r := v[3].r), struct_pack(c := w.c + more + case initial when 'u' then 0 else 1000000000 end, a := w.a || 'K', r := w.r || line),
                            struct_pack(c := w.c + more + 3, a := w.a || 'R', r := w.r || chr(10) || 'user:' || text)) as u,
                        least(struct_pack(c := v[4].c + 4, a := v[4].a || 'D', r := v[4].r), struct_pack(c := v[3].c + more + case initial when 'a' then 0 else 1000000000 end, a := v[3].a || 'K', r := v[3].r || line),
                            struct_pack(c := v[3].c + more + 3, a := v[3].a || 'R', r := v[3].r || chr(10) || 'assistant:' || text)) as a
                    from (select *, least(v[1], v[2], v[4]) as w from t) t
                    join (select *, case fault when 'truncated' then 3 when '' then 0 else 1000000000 end as more from f) f on t.conv_id is not distinct from f.conv_id and f.pos = t.pos + 1))),
        e as (select g.*, least(v[1], v[4]) as best from t join g on t.conv_id is not distinct from g.conv_id and t.pos = g.many)
        select i.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
            coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit, sha256(coalesce(best.r[2:], '')) as repaired_sha256
        from (select distinct conv_id from conversations) i left join e on i.conv_id is not distinct from e.conv_id""",
    # the five letters in all orders, each filter applied to what those before it left
    "op13_filter_audit": rf"""
        with recursive d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
        w as (select *, list_filter(string_split_regex(text, '{_SPACE}+'), lambda x: x <> '') as words, min(doc_id) over (partition by text) as first_id from d),
        f as (select part, len(words) < 200 as a, 100 * len(list_distinct(words)) < 50 * len(words) as b,
                100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text) as c, regexp_matches(text, '[#$%&*|]') as d, coalesce(doc_id > first_id, false) as e,
                coalesce(good, false) as good, coalesce(toxic, false) as toxic
            from w left join (select doc_id as id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by 1) l on doc_id = id),
        m as (select part, good, toxic, case when a then 'A' else '' end || case when b then 'B' else '' end || case when c then 'C' else '' end || case when d then 'D' else '' end || case when e then 'E' else '' end as failed,
                count(*) as n from f group by all),
        x as (select unnest(['A', 'B', 'C', 'D', 'E']) as letter),
        o as (select letter as o from x union all select o || letter from o, x where not contains(o, letter)),
        s as (select o as filter_order, step::int as step, o[step:step] as filter, o[1:step] as upto, o[1:step-1] as earlier from o, range(1, 6) as r(step) where length(o) = 5),
        r as (select part, filter_order, step, filter, contains(failed, filter) as fails, len(list_filter(string_split(earlier, ''), lambda z: contains(failed, z) and z <> '')) > 0 as gone, failed, n, good, toxic from m, s),
        t as (select part, filter_order, step, filter, coalesce(sum(n) filter (not fails and not gone), 0)::bigint as kept, coalesce(sum(n) filter (fails and not gone), 0)::bigint as removed,
                coalesce(sum(n) filter (fails and gone), 0)::bigint as redundant, coalesce(sum(n) filter (failed = filter), 0)::bigint as unique_fails,
                coalesce(sum(n) filter (fails and not gone and good), 0)::bigint as good_lost, coalesce(sum(n) filter (fails and not gone and toxic), 0)::bigint as toxic_lost from r group by all)
        select *, (sum(removed) over (partition by part, filter))::bigint as shapley from t""",
}
