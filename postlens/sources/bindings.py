"""The logical tables of job-posting intelligence over the given tables, in Spark and in DuckDB SQL.

`Tables(spark, sf_dir).jobs` is a DataFrame; CTES["jobs"] is the same table for a SQL check. All columns
come from the given rows by arithmetic, so the tables grow with them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.functions.text import REQ_MAX, REQ_MIN
from postlens.sources.sinks import shared_folder, write_table

#: The clock of queries over orders and of those over events.
AS_OF, EVENTS_AS_OF = "2001-08-01", "2024-01-31"


#: Words of documents and what stands for them in resume lines, so that the rules of imports have hits and misses.
RESUME_WORDS = {
    "the": "医院", "of": "助理", "and": "2021-2023", "in": "项目", "to": "熟悉SPSS", "is": "硕士", "with": "大学", "this": "发表论文", "der": "护士资格证", "die": "英语", "und": "六级", "le": "一等奖", "la": "教学", "el": "未取得",
    "en": "2019.3-至今", "The": "\n- ", "For": "\n【教育经历】\n", "As": "\n技能\n", "Der": "\n一、工作经历\n", "Le": "\n姓名：王小明\n", "Die": "13812345678", "El": "a.b@c.org", "On": "学校：某某学院", "An": "\n张三丰\n",
}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table in the shared folder, for what a query uses several times."""
        return write_table(df, shared_folder(self.spark, name))

    @cached_property
    def institutions(self) -> DataFrame:
        nation = self.read("nation").join(F.broadcast(self.read("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
        return (
            self.read("supplier")
            .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("r_name").alias("institution_type"), F.col("n_name").alias("region"),
                F.format_string("https://org%d.example/", "s_suppkey").alias("official_url"), F.format_string("https://org%d.example/%s", F.col("s_suppkey"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise("jobs")).alias("listing_url"),
                F.when(F.col("s_suppkey") % 4 == 0, "generic").otherwise("adapter").alias("crawl_strategy"), (F.col("s_suppkey") % 5 != 0).alias("enabled"),
                F.when(F.col("s_suppkey") % 7 == 0, "failed").when(F.col("s_suppkey") % 11 == 0, "review").otherwise("ok").alias("last_status"),
            )
        )

    @cached_property
    def _sources(self) -> F.Column:
        """The number of institutions, counted once; null if there is none."""
        return F.lit(self.read("supplier").count() or None).cast("long")

    def _institution_of(self, key) -> F.Column:
        return (key % self._sources).cast("long")

    @cached_property
    def jobs(self) -> DataFrame:
        inst = self.institutions.select(F.col("id").alias("institution_id"), F.col("name").alias("institution_name"), "institution_type", "region", F.col("enabled").alias("institution_enabled"))
        k = F.col("o_orderkey")
        orders = (
            self.read("orders")
            .join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .withColumn("institution_id", self._institution_of(F.col("o_custkey")))
        )
        parsers = F.array(*map(F.lit, ("demo-fixture-v1", "generic-visible-page-v1", "generic-fallback-v1", "alpha-v1", "beta-v1")))
        return orders.join(inst, "institution_id").select(
            k.alias("id"), "institution_id", "institution_name", "institution_type", "region", "institution_enabled",
            F.concat_ws(" ", "o_orderpriority", "c_name").alias("title"),
            F.col("o_orderpriority").alias("job_category"),
            F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, "").otherwise(F.col("o_orderstatus")).alias("education"),
            F.when(k % 13 == 0, F.lit(None)).otherwise(F.get(parsers, (k % 5).cast("int"))).alias("parser_name"),
            ((k % 46 + 50) / 100).alias("confidence"),
            F.concat_ws(" ", "c_name", "c_mktsegment", "o_orderpriority").alias("raw_text"),
            F.array(F.col("region"), F.col("institution_type"), F.col("o_orderpriority"), F.col("c_mktsegment"), F.format_string("tag%d", k % 9)).alias("tags"),
            F.when(k % 4 == 0, F.format_string("https://files.example/%d.xlsx", k)).alias("attachment_url"),
            F.when(k % 6 == 0, k % 3 + 1).otherwise(0).cast("long").alias("failed_attachments"),
            F.col("o_orderdate").cast("timestamp").alias("fetched_at"),
            F.format_string("https://jobs.example/%d", k).alias("source_url"),
        )

    @cached_property
    def statuses(self) -> DataFrame:
        """A log of private job statuses: one row a line item; quantity over 45 deletes."""
        return self.read("lineitem").select(
            (F.col("l_suppkey") % 20).cast("long").alias("user_id"), F.col("l_orderkey").alias("job_id"), F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("note"),
            F.col("l_shipdate").cast("timestamp").alias("happened"), F.struct("l_shipdate", "l_partkey", "l_linenumber", "l_quantity").alias("seq"), (F.col("l_quantity") > 45).alias("deleted"),
        )

    @cached_property
    def observations(self) -> DataFrame:
        return (
            self.read("lineitem")
            .select(
                self._institution_of(F.col("l_partkey")).alias("institution_id"), F.format_string("https://jobs.example/p/%d", "l_partkey").alias("source_url"),
                F.sha2("l_returnflag", 256).alias("source_text_hash"), F.col("l_returnflag").alias("raw_text"), F.format_string("%s parser", "l_linestatus").alias("parser_name"),
                F.format_string("name %d", F.col("l_suppkey") % 7).alias("institution_name"), F.col("l_shipdate").cast("timestamp").alias("fetched_at"),
                F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey").alias("seq"),
            )
        )

    @cached_property
    def outcomes(self) -> DataFrame:
        """Crawl outcomes: a run is a day, an institution a user of events."""
        ts = F.col("ts").cast("timestamp")
        return self.read("events").select(
            F.datediff(ts, F.lit("2023-12-31")).cast("long").alias("run_id"), F.col("user_id").alias("institution_id"), F.col("event_id").alias("seq"), ts.alias("happened"),
            (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") == "error", 0).otherwise(F.floor(F.abs("value")) % 4).cast("long").alias("n_postings"),
            F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "network").otherwise("outbound_blocked")).alias("error_type"),
            F.when(F.col("user_id") % 3 == 0, "manual").otherwise("auto").alias("trigger"),
        )

    @cached_property
    def postings_text(self) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        return self.read("documents").select(
            F.col("doc_id").alias("id"), F.col("source").alias("institution"), F.col("lang").alias("region"), F.substring_index(text, "\n", 1).alias("title"), text.alias("body")
        )

    @cached_property
    def subscriptions(self) -> DataFrame:
        k = F.col("s_suppkey")
        words = F.array(*map(F.lit, ("urgent", "HIGH", "customer", "machinery", "specified", " ", "build", "supplier")))
        ids = F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: (k + i * 3) % self._sources)
        at = F.timestamp_add("DAY", (k % 900).cast("int"), F.lit("1999-01-01").cast("timestamp"))
        return (
            self.read("supplier")
            .select(
                k.alias("id"), (k % 20).alias("user_id"), F.get(words, (k % 8).cast("int")).alias("keyword"), F.array_distinct(ids).alias("institution_ids"),
                at.alias("last_checked_at"), F.when(k % 3 == 0, F.timestamp_add("DAY", F.lit(60), at)).alias("last_pushed_at"), F.timestamp_add("DAY", F.lit(-30), at).alias("created_at"), (k % 17 == 0).alias("deleted"),
            )
        )

    @cached_property
    def intervals(self) -> DataFrame:
        """Profile entries with raw dates: an order is an entry of its customer."""
        days = self.read("lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").cast("int").alias("days"))
        o, start = F.col("o_orderkey"), F.to_date("o_orderdate")
        return (
            self.read("orders")
            .join(days, F.col("l_orderkey") == o, "left")
            .select(
                F.col("o_custkey").alias("user_id"), F.when(o % 3 == 0, "education").otherwise("experiences").alias("collection"), o.alias("item_id"),
                F.when(o % 29 == 0, F.date_format(start, "yyyy.MM")).when(o % 23 == 0, F.date_format(start, "yyyy")).when(o % 19 == 0, F.date_format(start, "yyyy-M")).otherwise(F.date_format(start, "yyyy-MM-dd")).alias("start_raw"),
                F.when(o % 31 == 0, "present").when(F.col("days").isNull(), "").otherwise(F.date_format(F.date_add(start, F.coalesce("days", F.lit(0))), "yyyy-M-d")).alias("end_raw"),
            )
        )

    @cached_property
    def requirements(self) -> DataFrame:
        """Clauses of postings: sentences of documents of a clause's length."""
        cut = self.postings_text.select(F.col("id").alias("job_id"), "institution", "region", F.posexplode(F.split(F.regexp_replace("body", "\n", " "), "[.!]")).alias("ord", "clause"))
        return cut.withColumns({"clause": F.trim("clause"), "ord": F.col("ord").cast("long")}).filter(F.length("clause").between(REQ_MIN, REQ_MAX))

    @cached_property
    def resume_lines(self) -> DataFrame:
        """Lines of documents in which some words stand for the vocabulary of resumes."""
        said = F.create_map(*[F.lit(x) for kv in RESUME_WORDS.items() for x in kv])
        words = F.transform(F.split(F.coalesce("text", F.lit("")), " ", -1), lambda w: F.coalesce(F.try_element_at(said, w), w))
        lines = F.split(F.regexp_replace(F.array_join(words, " "), "[.!?] ", "\n"), "\n", -1)
        return self.read("documents").select("doc_id", F.posexplode(lines).alias("line_no", "text")).withColumn("text", F.trim("text"))

    @cached_property
    def facts(self) -> DataFrame:
        return self.read("conversations").select(
            F.col("conv_id").alias("user_id"), F.format_string("%d-%d", "conv_id", "turn").alias("field_id"), F.col("role").alias("collection"), F.col("turn").alias("idx"), F.coalesce("text", F.lit("")).alias("text")
        )

    @cached_property
    def views(self) -> DataFrame:
        """What a user's list of jobs is narrowed to: an institution and a region, both by the user's number."""
        users = self.read("conversations").filter("conv_id is not null").select(F.col("conv_id").alias("user_id")).distinct()
        return users.select("user_id", F.format_string("src%d", F.col("user_id") % 20).alias("institution"), F.get(F.array(*map(F.lit, ("en", "de", "es", "fr"))), (F.floor(F.col("user_id") / 20) % 4).cast("int")).alias("region"))

    @cached_property
    def draft_items(self) -> DataFrame:
        """Items of drafts: a line of an order; a section is a ship-year, a decision the return flag."""
        l = self.read("lineitem")  # noqa: E741
        return l.select(
            F.col("l_orderkey").alias("draft_id"), (F.col("l_orderkey") % 50).alias("user_id"),
            F.get(F.array(*map(F.lit, ("identity", "education", "experiences", "skills", "gaps"))), (F.col("l_linenumber") % 5).cast("int")).alias("section_id"),
            F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("pos"), F.format_string("part %d of supplier %d", "l_partkey", "l_suppkey").alias("text"),
            F.when(F.col("l_returnflag") == "A", "adopt").when(F.col("l_returnflag") == "R", "remove").alias("decision"),
            F.when(F.col("l_suppkey") % 9 == 0, F.lit(None)).otherwise(F.col("l_partkey")).alias("field_id"),
        )

    @cached_property
    def draft_facts(self) -> DataFrame:
        return self.read("part").filter("p_size < 40").select(F.col("p_partkey").alias("field_id"))


_SAID = " ".join(f"when '{w}' then " + " || chr(10) || ".join(f"'{x}'" for x in said.split("\n")) for w, said in RESUME_WORDS.items())

_INST = "({key}) % (select count(*) from supplier)"

CTES = {
    "institutions": """select s_suppkey as id, s_name as name, r_name as institution_type, n_name as region, 'https://org' || s_suppkey || '.example/' as official_url,
        'https://org' || s_suppkey || '.example/' || case when s_suppkey % 3 = 0 then '' else 'jobs' end as listing_url, case when s_suppkey % 4 = 0 then 'generic' else 'adapter' end as crawl_strategy,
        s_suppkey % 5 <> 0 as enabled, case when s_suppkey % 7 = 0 then 'failed' when s_suppkey % 11 = 0 then 'review' else 'ok' end as last_status
        from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "jobs": f"""select o_orderkey as id, i.id as institution_id, i.name as institution_name, i.institution_type, i.region, o_orderpriority || ' ' || c_name as title, o_orderpriority as job_category,
        case when o_orderkey % 7 = 0 then null when o_orderkey % 11 = 0 then '' else o_orderstatus end as education,
        case when o_orderkey % 13 = 0 then null else ['demo-fixture-v1', 'generic-visible-page-v1', 'generic-fallback-v1', 'alpha-v1', 'beta-v1'][o_orderkey % 5 + 1] end as parser_name,
        (o_orderkey % 46 + 50) / 100 as confidence, c_name || ' ' || c_mktsegment || ' ' || o_orderpriority as raw_text,
        [i.region, i.institution_type, o_orderpriority, c_mktsegment, 'tag' || (o_orderkey % 9)] as tags, case when o_orderkey % 4 = 0 then 'https://files.example/' || o_orderkey || '.xlsx' end as attachment_url,
        case when o_orderkey % 6 = 0 then o_orderkey % 3 + 1 else 0 end as failed_attachments, o_orderdate::timestamp as fetched_at, 'https://jobs.example/' || o_orderkey as source_url
        from orders join customer on o_custkey = c_custkey join institutions i on i.id = {_INST.format(key="o_custkey")}""",
    "statuses": """select l_suppkey % 20 as user_id, l_orderkey as job_id, l_linestatus as status, l_returnflag as note, l_shipdate::timestamp as happened,
        row(l_shipdate, l_partkey, l_linenumber, l_quantity) as seq, l_quantity > 45 as deleted from lineitem""",
    "observations": f"""select {_INST.format(key="l_partkey")} as institution_id, 'https://jobs.example/p/' || l_partkey as source_url, sha256(l_returnflag) as source_text_hash, l_returnflag as raw_text,
        l_linestatus || ' parser' as parser_name, 'name ' || (l_suppkey % 7) as institution_name, l_shipdate::timestamp as fetched_at, row(l_shipdate, l_orderkey, l_linenumber, l_suppkey) as seq from lineitem""",
    "outcomes": """select datediff('day', date '2023-12-31', ts::date) as run_id, user_id as institution_id, event_id as seq, ts as happened, event_type <> 'error' as ok,
        case when event_type = 'error' then 0 else floor(abs(value))::bigint % 4 end as n_postings, case when event_type = 'error' then case when event_id % 2 = 0 then 'network' else 'outbound_blocked' end end as error_type,
        case when user_id % 3 = 0 then 'manual' else 'auto' end as trigger from events""",
    "postings_text": "select doc_id as id, source as institution, lang as region, split_part(coalesce(text, ''), chr(10), 1) as title, coalesce(text, '') as body from documents",
    "subscriptions": """select s_suppkey as id, s_suppkey % 20 as user_id, ['urgent', 'HIGH', 'customer', 'machinery', 'specified', ' ', 'build', 'supplier'][s_suppkey % 8 + 1] as keyword,
        list_distinct([(s_suppkey + i * 3) % sources for i in range(0, s_suppkey % 4 + 1)]) as institution_ids,
        timestamp '1999-01-01' + to_days((s_suppkey % 900)::int) as last_checked_at, case when s_suppkey % 3 = 0 then timestamp '1999-01-01' + to_days((s_suppkey % 900 + 60)::int) end as last_pushed_at,
        timestamp '1999-01-01' + to_days((s_suppkey % 900 - 30)::int) as created_at, s_suppkey % 17 = 0 as deleted from supplier, (select count(*) as sources from supplier)""",
    "intervals": """select o_custkey as user_id, case when o_orderkey % 3 = 0 then 'education' else 'experiences' end as collection, o_orderkey as item_id,
        case when o_orderkey % 29 = 0 then strftime(o_orderdate, '%Y.%m') when o_orderkey % 23 = 0 then strftime(o_orderdate, '%Y') when o_orderkey % 19 = 0 then strftime(o_orderdate, '%Y-%-m') else strftime(o_orderdate, '%Y-%m-%d') end as start_raw,
        case when o_orderkey % 31 = 0 then 'present' when days is null then '' else strftime(o_orderdate::date + days, '%Y-%-m-%-d') end as end_raw
        from orders left join (select l_orderkey, max(l_quantity)::int as days from lineitem group by 1) on l_orderkey = o_orderkey""",
    "requirements": """select job_id, institution, region, ord, clause from (select id as job_id, institution, region, ord - 1 as ord, trim(parts[ord]) as clause from (
        select id, institution, region, parts, unnest(range(1, len(parts) + 1)) as ord from (select id, institution, region, string_split_regex(replace(body, chr(10), ' '), '[.!]') as parts from postings_text))) where length(clause) between 4 and 140""",
    "resume_lines": f"""select doc_id, i - 1 as line_no, trim(parts[i]) as text from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as i from (select doc_id, string_split(regexp_replace(array_to_string(
        list_transform(string_split(coalesce(text, ''), ' '), lambda w: case w {_SAID} else w end), ' '), '[.!?] ', chr(10), 'g'), chr(10)) as parts from documents))""",
    "facts": "select conv_id as user_id, conv_id || '-' || turn as field_id, role as collection, turn as idx, coalesce(text, '') as text from conversations",
    "views": "select user_id, 'src' || (user_id % 20) as institution, ['en', 'de', 'es', 'fr'][(user_id // 20) % 4 + 1] as region from (select distinct conv_id as user_id from conversations where conv_id is not null)",
    "draft_items": """select l_orderkey as draft_id, l_orderkey % 50 as user_id, ['identity', 'education', 'experiences', 'skills', 'gaps'][l_linenumber % 5 + 1] as section_id,
        row(l_linenumber, l_partkey, l_suppkey, l_quantity) as pos, 'part ' || l_partkey || ' of supplier ' || l_suppkey as text,
        case l_returnflag when 'A' then 'adopt' when 'R' then 'remove' end as decision, case when l_suppkey % 9 = 0 then null else l_partkey end as field_id from lineitem""",
    "draft_facts": "select p_partkey as field_id from part where p_size < 40",
}
