"""Profiles from JSON documents, facts from profiles, lines from resumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.text import txt_normalize
from postlens.operators.intervals import skill_level_map

#: Fields of each collection, in order, and what its items are.
FIELDS = {
    "education": ("school", "degree", "major", "start", "end"), "experiences": ("organization", "role", "start", "end"), "projects": ("name", "role"), "publications": ("title", "journal", "year", "authors", "doi"),
    "certificates": ("name", "issuer", "year"), "skills": ("name", "level"), "teaching": ("course", "role", "institution", "year"), "awards": ("name", "issuer", "year", "level"), "languages": ("name", "level"),
}
LISTS = {"education": ("highlights",), "experiences": ("highlights", "skills"), "projects": ("highlights", "skills")}
KEYWORDS = {"publications": "发表论文 学术论文 科研成果", "certificates": "证书 资格", "education": "学历 学位 专业", "teaching": "教学 授课", "awards": "获奖 荣誉", "languages": "语言能力"}
NOT_TEXT = ("id", "doi", "level")
LABELS = ("organization", "school", "name", "title", "course", "role")
BASICS = ("name", "phone", "email", "location", "intended_position", "summary")
MAX_LINES, MAX_CHARS, MAX_LINE = 10_000, 500_000, 10_000


def _item(collection: str) -> str:
    fields = ["id string", *[f"{f} string" for f in FIELDS[collection]], *[f"{f} array<string>" for f in LISTS.get(collection, ())]]
    return f"struct<{', '.join(f.replace(' ', ': ', 1) for f in fields)}>"


def load_profiles(rows: DataFrame) -> DataFrame:
    """rows: user_id, data (JSON). basics, nine arrays and mode; an entry that is no object is dropped, a broken document is an empty profile."""
    basics = f"struct<{', '.join(f'{b}: string' for b in BASICS)}>"
    raw = F.from_json("data", f"struct<basic: {basics}, basics: {basics}, mode: string, {', '.join(f'{c}: array<string>' for c in FIELDS)}>")
    read = rows.select("user_id", raw.alias("r"))

    def items(c: str) -> Column:
        good = F.filter(F.coalesce(F.col(f"r.{c}"), F.expr("cast(array() as array<string>)")), lambda x: F.trim(x).startswith("{"))
        out = F.transform(good, lambda x: F.from_json(x, _item(c)))
        return F.transform(out, lambda x: x.withField("level", skill_level_map(x["level"]))) if c == "skills" else out

    return read.select("user_id", F.coalesce("r.basics", "r.basic").alias("basics"), F.coalesce("r.mode", F.lit("experienced")).alias("mode"), *[items(c).alias(c) for c in FIELDS])


def fact_text(item: Column, collection: str) -> Column:
    """Descriptive fields, no bare numbers, lists in full, then what the collection is."""
    fields = [F.when(~F.trim(item[f]).rlike(r"^\d+$"), item[f]) for f in FIELDS[collection] if f not in NOT_TEXT]
    lists = [F.array_join(item[f], " ") for f in LISTS.get(collection, ())]
    return txt_normalize(F.concat_ws(" ", *fields, *lists, F.lit(KEYWORDS.get(collection, ""))))


def fact_flatten(profiles: DataFrame) -> DataFrame:
    """One row an item: user_id, collection, idx, field_id, label, text."""
    out = None
    for c in FIELDS:
        each = profiles.select("user_id", F.posexplode(c).alias("idx", "item"))
        item = F.col("item")
        label = F.coalesce(*[F.nullif(item[f], F.lit("")) for f in LABELS if f in FIELDS[c]], F.format_string("#%d", F.col("idx") + 1))
        field = F.coalesce(F.nullif(item["id"], F.lit("")), F.format_string(f"{c}-%d", F.col("idx") + 1))
        rows = each.select("user_id", F.lit(c).alias("collection"), "idx", field.alias("field_id"), label.alias("label"), fact_text(item, c).alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_lines(docs: DataFrame, markdown: bool = False) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, text. Ordered lines, and the documents that are turned away whole (doc_id, rejected: lines, characters
    or line, whichever limit is passed first)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n", -1)
    reason = F.when(F.size(lines) > MAX_LINES, "lines").when(F.length(text) > MAX_CHARS, "characters").when(F.exists(lines, lambda x: F.length(x) > MAX_LINE), "line")
    judged = docs.withColumn("rejected", reason)
    cut = judged.filter("rejected is null").select("doc_id", F.posexplode(lines).alias("line_no", "text"))
    kept = cut.withColumn("text", F.trim(F.regexp_replace("text", r"^\s*#+\s*", "") if markdown else F.col("text")))
    return kept, judged.filter("rejected is not null").select("doc_id", "rejected")


def md_line_kinds(lines: DataFrame) -> DataFrame:
    """kind: heading (with level), bullet, paragraph or blank; content without the mark."""
    t = F.trim("text")
    kind = F.when(t == "", "blank").when(t.rlike(r"^#{1,6}\s+"), "heading").when(t.rlike(r"^(?:[-*+]|\d+[.)])\s+"), "bullet").otherwise("paragraph")
    content = F.regexp_replace(t, r"^(?:#{1,6}|[-*+]|\d+[.)])\s+", "")
    return lines.withColumns({"kind": kind, "level": F.when(kind == "heading", F.length(F.regexp_extract(t, r"^(#+)", 1))), "content": content})


def import_merge(profiles: DataFrame, candidates: DataFrame, selected: DataFrame, basics: DataFrame) -> DataFrame:
    """Selected candidates (doc: user_id, collection, item_id, text) join the items of a user; basics overwrite. user_id, name, items, accepted."""
    taken = candidates.join(selected, ["user_id", "item_id"], "left_semi")
    new = taken.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("collection", "item_id", "text"))).alias("_new"))
    named = basics.select("user_id", F.col("name").alias("_name"))
    out = profiles.join(new, "user_id", "left").join(named, "user_id", "left")
    return out.select("user_id", F.coalesce(F.nullif("_name", F.lit("")), "name").alias("name"), F.concat("items", F.coalesce(F.transform("_new", lambda x: x["text"]), F.expr("cast(array() as array<string>)"))).alias("items"), F.coalesce(F.size("_new"), F.lit(0)).cast("long").alias("accepted"))
