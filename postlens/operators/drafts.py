"""Resume drafts: item lines, sections, review state, links to facts, export views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.operators.running import Keep, running

DECISIONS = ("adopt", "edit", "remove")
#: Drafts a page of a field's references.
PAGE = 100
#: Sections without evidence, and the title of one.
SKIP_SECTIONS = ("identity", "target", "gaps", "appendix", "appendix-satisfied", "appendix-unmet", "appendix-unlinked")
SKIP_TITLE = "投递前需补充确认"
CONTACTS = (("phone", "电话"), ("email", "邮箱"), ("location", "所在地"), ("intended_position", "求职意向"))
NO_NAME = "（未填写姓名）"
#: The fields that lead an item's line, in order.
HEAD_FIELDS = {
    "education": ("school", "degree", "major"), "experiences": ("organization", "role"), "projects": ("name", "role"), "publications": ("title", "journal", "year"), "certificates": ("name", "issuer", "year"),
    "skills": ("name", "level"), "teaching": ("course", "role", "institution", "year"), "awards": ("name", "issuer", "level", "year"), "languages": ("name", "level"),
}
SECTION_TITLES = {
    "education": "教育背景", "experiences": "工作/实习经历", "projects": "科研/项目经历", "publications": "论文成果", "certificates": "证书资质", "skills": "技能能力", "teaching": "教学经历", "awards": "获奖经历", "languages": "语言能力",
}


def _said(c: Column) -> Column:
    return F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c))


def joined(parts: list[Column], by: str) -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), by)


def item_text(head: list[Column], start: Column, end: Column, details: Column, rest: Column) -> Column:
    """Head fields and the period by ` / `, then `：` and details by `；`; of an item with neither its other prose."""
    period = joined([_said(start), _said(end)], "-")
    line = joined([*[_said(h) for h in head], _said(period)], " / ")
    kept = F.filter(F.transform(F.coalesce(details, F.expr("cast(array() as array<string>)")), lambda d: F.trim(d)), lambda d: d != "")
    body = F.array_join(kept, "；")
    return F.when((body != "") & (line != ""), F.concat(line, F.lit("："), body)).when(body != "", body).when(line != "", line).otherwise(F.trim(F.coalesce(rest, F.lit(""))))


def identity_lines(basics: DataFrame) -> DataFrame:
    """user_id, lines: name, contacts by ` ｜ `, summary; users with neither name nor contact have none."""
    contact = joined([F.when(_said(F.col(f)).isNotNull(), F.concat(F.lit(f"{label}："), _said(F.col(f)))) for f, label in CONTACTS], " ｜ ")
    lines = F.array_compact(F.array(F.coalesce(_said(F.col("name")), F.lit(NO_NAME)), _said(contact), _said(F.col("summary"))))
    return basics.filter(_said(F.col("name")).isNotNull() | (contact != "")).select("user_id", lines.alias("lines"))


def sections(items: DataFrame, matched: DataFrame, gaps: DataFrame, most_gaps: int = 5) -> DataFrame:
    """items: user_id, collection, idx, field_id, text; matched: user_id, field_id; gaps: user_id, ord, message.

    One row a section: user_id, section, lines. Items that match lead, in their order.
    """
    m = matched.select("user_id", "field_id").distinct().withColumn("_matched", F.lit(True))
    own = items.filter(F.col("text") != "").join(m, ["user_id", "field_id"], "left")
    line = F.struct(F.col("_matched").isNull().alias("supporting"), "idx", "text")
    body = own.groupBy("user_id", F.col("collection").alias("section")).agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["text"]).alias("lines"))
    open_ = gaps.groupBy("user_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("ord", "message"))), 1, most_gaps).alias("g"))
    return body.unionByName(open_.select("user_id", F.lit("gaps").alias("section"), F.transform("g", lambda x: x["message"]).alias("lines")))


def review(items: DataFrame) -> DataFrame:
    """items: draft_id, pos, decision. status (reviewed if each item is decided), pending, first_pending (place from 0), n_items."""
    decided = F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False))
    undecided = F.array_sort(F.collect_list(F.struct("pos", decided.alias("decided"))))
    each = items.groupBy("draft_id").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(~decided).alias("pending"), undecided.alias("all"))
    first = F.array_position(F.transform("all", lambda x: x["decided"]), False) - 1
    return each.select("draft_id", F.when(F.col("pending") == 0, "reviewed").otherwise("draft").alias("status"), "pending", F.when(F.col("pending") > 0, first).alias("first_pending"), "n_items")


def unlinked(items: DataFrame, facts: DataFrame) -> DataFrame:
    """Items outside the skipped sections, not removed, without a reference to one of facts (field_id)."""
    own = items.filter(~F.col("section_id").isin(*SKIP_SECTIONS) & (F.coalesce("decision", F.lit("")) != "remove"))
    return own.join(facts.select("field_id").distinct(), "field_id", "left_anti")


def export_view(items: DataFrame) -> DataFrame:
    """Without removed items and the gap section; sections that lose all their items stay, with none."""
    own = items.filter("section_id <> 'gaps'")
    line = F.when(F.coalesce("decision", F.lit("")) != "remove", F.struct("pos", "text"))
    return own.groupBy("draft_id", "section_id").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["text"]).alias("lines"))


def export_gate(reviewed: DataFrame, loose: DataFrame, application: Column, override: Column) -> DataFrame:
    """code: 422 without items, 409 unreviewed, 409 with unlinked items in an application, else 200; an override lets the last two pass."""
    n = loose.groupBy("draft_id").agg(F.count(F.lit(1)).alias("n_unlinked"))
    out = reviewed.join(n, "draft_id", "left").fillna(0, ["n_unlinked"])
    code = F.when(F.col("n_items") == 0, 422).when((F.col("status") != "reviewed") & ~override, 409).when(application & (F.col("n_unlinked") > 0) & ~override, 409).otherwise(200)
    return out.withColumn("code", code.cast("long"))


def field_references(items: DataFrame, keep: Keep, page: int = PAGE) -> DataFrame:
    """By user and field the drafts that cite it, in pages: user_id, field_id, n_drafts, page (from 0), draft_ids (at most `page`, in order).

    A field that all drafts cite has many rows of a bounded size. Places in the list are running counts over
    segments, so such a field is no task's alone.
    """
    cited = items.filter("field_id is not null").select("user_id", "field_id", "draft_id").distinct()
    placed = running(cited, ["user_id", "field_id"], ["draft_id"], keep, {"_place": F.lit(1).cast("long")})
    number = F.floor((F.col("_place") - 1) / page).cast("long")
    pages = placed.groupBy("user_id", "field_id", number.alias("page")).agg(F.array_sort(F.collect_list("draft_id")).alias("draft_ids"), F.max("_place").alias("_place"))
    pages = keep(pages, "field-pages")
    counts = pages.groupBy(F.col("user_id").alias("_user"), F.col("field_id").alias("_field")).agg(F.max("_place").alias("n_drafts"))
    return pages.join(counts, F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("field_id") == F.col("_field"))).select("user_id", "field_id", "n_drafts", "page", "draft_ids")


def appendix_met(requirement: Column, label: Column, source: Column, strength: Column) -> Column:
    detail = joined([_said(label), _said(source)], "：")
    return joined([F.trim(requirement), F.when(detail != "", F.concat(F.lit("证据："), detail)), F.when(_said(strength).isNotNull(), F.concat(F.lit("强度："), _said(strength)))], " — ")


def appendix_unmet(requirement: Column, message: Column, blocking: Column) -> Column:
    return joined([F.trim(requirement), F.when(_said(message).isNotNull(), F.concat(F.lit("建议："), _said(message))), F.when(blocking, "（硬性条件不满足）")], " — ")


_PERIOD = r"^\d{4}([-./]\d{1,2})?(-\d{4}([-./]\d{1,2})?)?$"


def entry_structure(line: Column) -> Column:
    """head, role, period, details of a resume line; a split that would lose anything but separators gives the raw line as one detail."""
    text = F.trim(line)
    at = F.locate("：", text)
    head_part = F.trim(F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text))
    items = lambda c: F.filter(F.transform(F.split(c, "；"), lambda d: F.trim(d)), lambda d: d != "")
    none, no_text = F.expr("cast(array() as array<string>)"), F.lit(None).cast("string")
    prose = (at == 0) & ~head_part.contains(" / ") & head_part.contains("；")
    details = F.when(at > 0, items(F.substring(text, at + 1, F.length(text)))).when(prose, items(head_part)).otherwise(none)
    cut = F.transform(F.split(head_part, " / "), lambda s: F.trim(s))
    lone = (at == 0) & ~head_part.contains(" / ")
    dated = F.element_at(cut, -1).rlike(_PERIOD) & ~lone
    segments = F.when(dated, F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)
    no_head = prose | (head_part == "")
    head = F.when(no_head, no_text).otherwise(F.get(segments, 0))
    role = F.when(no_head | (F.size(segments) < 2), no_text).otherwise(F.array_join(F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))), " · "))
    period = F.when(no_head | ~dated, no_text).otherwise(F.element_at(cut, -1))
    bare = lambda c: F.regexp_replace(c, r"[\s/：；·—–]", "")
    whole = bare(F.concat_ws("", head, role, period, F.array_join(details, ""))) == bare(line)
    return F.when(whole, F.struct(head.alias("head"), role.alias("role"), period.alias("period"), details.alias("details"))).otherwise(
        F.struct(no_text.alias("head"), no_text.alias("role"), no_text.alias("period"), F.array(text).alias("details"))
    )


def plain_text(items: DataFrame, title: Column) -> DataFrame:
    """One text a draft: title, blank line, then each section's name, `- ` items and a blank line, in the order of sections' first items."""
    section = items.groupBy("draft_id", "section_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("own"))
    body = F.concat(F.array(F.col("section_id")), F.transform("own", lambda x: F.concat(F.lit("- "), x["text"])), F.array(F.lit("")))
    ordered = section.select("draft_id", F.col("own")[0]["pos"].alias("pos"), body.alias("lines"))
    return ordered.groupBy("draft_id").agg(F.array_join(F.concat(F.array(title, F.lit("")), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lines"))), lambda x: x["lines"]))), "\n").alias("text"))


def review_tone(strength: Column, level: Column) -> Column:
    """By the strength of the first evidence, else by the item's evidence level."""
    return F.when(strength == "strong", "green").when(strength.isin("partial", "weak"), "yellow").when(level == "matched", "green").when(level == "supporting", "yellow").otherwise("red")


def text_constraints(values: DataFrame, statuses: tuple[str, ...], longest: int = 20_000, most_chars: int = 500_000, most_items: int = 500) -> DataFrame:
    """values: doc_id, item, text, status. One row a violation: doc_id, rule, n."""
    each = F.array(
        F.when(F.col("text").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), "control character"), F.when(F.length("text") > longest, "value too long"), F.when(F.col("status").isNotNull() & ~F.col("status").isin(*statuses), "unknown status")
    )
    single = values.select("doc_id", F.explode(F.array_compact(each)).alias("rule")).groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("n"))
    sums = values.groupBy("doc_id").agg(F.sum(F.length("text").cast("long")).alias("chars"), F.count(F.lit(1)).alias("items"))
    whole = sums.select("doc_id", F.inline(F.array_compact(F.array(F.when(F.col("chars") > most_chars, F.struct(F.lit("too many characters").alias("rule"), F.col("chars").alias("n"))), F.when(F.col("items") > most_items, F.struct(F.lit("too many items").alias("rule"), F.col("items").alias("n")))))))
    return single.unionByName(whole)
