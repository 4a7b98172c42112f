"""From page events and attachment grids to postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions import text as T
from postlens.lexicon import ZH_MEDICAL, Lexicon

MAX_ROWS, MAX_COLUMNS, MAX_CELLS = 5000, 128, 200_000
GENERIC_MIN, GENERIC_MAX, GENERIC_TOP, GENERIC_TITLE, GENERIC_BODY, IMAGES = 4, 80, 30, 60, 2000, 4


def absolute(base: Column, href: Column) -> Column:
    """href against the page's URL: whole URLs, //host, /path, ?query, #part and relative paths."""
    scheme, host = F.regexp_extract(base, r"^([a-z]+):", 1), F.regexp_extract(base, r"^([a-z]+://[^/?#]*)", 1)
    bare = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(bare.rlike(r"^[a-z]+://[^/]*$"), F.concat(bare, F.lit("/"))).otherwise(F.regexp_replace(bare, r"[^/]*$", ""))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href)).when(href.startswith("/"), F.concat(host, href))
        .when(href.startswith("?"), F.concat(bare, href)).when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), href)).otherwise(F.concat(folder, href))
    )


def page_links(events: DataFrame, pages: DataFrame, words: tuple[str, ...], min_len: int = 10, max_len: int = 80, container: str | None = None) -> DataFrame:
    """Anchors with a word whose text is longer than min_len and shorter than max_len; of a container if the page has it."""
    a = events.filter("kind = 'a'").withColumn("text", F.trim("text"))
    if container:
        inside = F.col("container") == container
        has = F.max(inside.cast("int")).over(Window.partitionBy("page_id"))
        a = a.withColumn("_has", has).filter((F.col("_has") == 0) | inside).drop("_has")
    hit = (F.length("text") > min_len) & (F.length("text") < max_len) & T.has(F.col("text"), words)
    return a.filter(hit).join(pages.select("page_id", "url"), "page_id").select("page_id", "pos", "text", absolute(F.col("url"), F.col("href")).alias("url"))


def page_links_dated(events: DataFrame, pages: DataFrame, date: str = r"(\d{4}[-/]\d{1,2}[-/]\d{1,2})", min_len: int = 6) -> DataFrame:
    """List items: first anchor inside, of at least min_len characters, and the item's date if it has one."""
    items = events.filter("kind in ('li', 'a')").withColumn("_li", F.max(F.when(F.col("kind") == "li", F.col("pos"))).over(Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    own = items.filter("_li is not null").groupBy("page_id", "_li").agg(F.min_by("text", "pos").alias("item"), F.min_by(F.when(F.col("kind") == "a", F.struct("text", "href")), F.when(F.col("kind") == "a", F.col("pos"))).alias("a"))
    return own.filter(F.length(F.trim("a.text")) >= min_len).join(pages.select("page_id", "url"), "page_id").select("page_id", F.trim("a.text").alias("text"), absolute(F.col("url"), F.col("a.href")).alias("url"), F.regexp_extract("item", date, 1).alias("posted_at"))


def page_generic_postings(events: DataFrame, pages: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """Anchors of 4 to 80 characters with a word, the first 30 of a page; a page without any is one posting itself."""
    text = T.txt_normalize(F.col("text"))
    a = events.filter("kind = 'a'").withColumn("text", text).filter(F.length("text").between(GENERIC_MIN, GENERIC_MAX) & T.has(F.col("text"), words))
    first = a.withColumn("_n", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).filter(F.col("_n") <= GENERIC_TOP).join(pages.select("page_id", "url"), "page_id")
    href = F.col("href")
    link = F.when(href.rlike(r"^https?:"), href).otherwise(F.concat(F.regexp_replace("url", "/+$", ""), F.lit("/"), F.regexp_replace(href, "^/+", "")))
    anchored = first.select("page_id", F.regexp_replace("text", r"^\d+[.、]\s*", "").alias("title"), link.alias("source_url"), F.lit("").alias("body"), F.lit("anchor").alias("kind"))
    rest = pages.join(a.select("page_id").distinct(), "page_id", "left_anti").select("page_id", "url")
    lines = events.filter("kind = 'line'").groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("body"), F.min_by("text", "pos").alias("title"))
    whole = rest.join(lines, "page_id", "left").select(
        "page_id", F.substring(F.coalesce("title", F.lit("")), 1, GENERIC_TITLE).alias("title"), F.col("url").alias("source_url"), F.substring(F.coalesce("body", F.lit("")), 1, GENERIC_BODY).alias("body"), F.lit("page").alias("kind")
    )
    return anchored.unionByName(whole)


def page_notice_sections(text: Column, title: str = "招聘岗位", duties: str = "岗位职责", conditions: tuple[str, ...] = ("招聘条件", "任职条件", "任职要求", "应聘条件"), ordinals: str = ZH_MEDICAL.ordinals) -> Column:
    """title, responsibilities, conditions of a notice, each from its heading to the next ordinal heading; body is the start if none is there."""
    part = lambda head: F.trim(F.regexp_extract(text, rf"(?s)(?:{head})[：:]?\s*(.*?)(?=[{ordinals}]+、|$)", 1))
    t, d, c = part(title), part(duties), part("|".join(conditions))
    return F.struct(t.alias("title"), d.alias("responsibilities"), c.alias("conditions"), F.when((d == "") & (c == ""), F.substring(text, 1, 2000)).otherwise(F.concat_ws(" ", d, c)).alias("body"), text.contains(duties).alias("department_notice"))


def page_article_lines(lines: DataFrame, words: tuple[str, ...], contact: tuple[str, ...], min_lines: int = 5) -> DataFrame:
    """lines: page_id, pos, text. title, posted_at and body of an article.

    The title is the first line with a word and 6 < length < 60, else the first one; the body ends before
    a contact line; an article needs five lines.
    """
    kept = lines.filter(F.trim("text") != "")
    ok = T.has(F.col("text"), words) & (F.length("text") > 6) & (F.length("text") < 60)
    date = F.regexp_extract("text", r"(\d{4}[-/年]\d{1,2}[-/月]\d{1,2}日?)", 1)
    head = kept.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.min(F.when(ok, F.col("pos"))), F.min("pos")).alias("at"), F.min_by(date, F.when(date != "", F.col("pos"))).alias("posted")
    ).filter(F.col("n") >= min_lines)
    own = kept.join(head, "page_id")
    stop = own.filter((F.col("pos") > F.col("at")) & T.has(F.col("text"), contact)).groupBy("page_id").agg(F.min("pos").alias("stop"))
    own = own.join(stop, "page_id", "left")
    inside = (F.col("pos") > F.col("at")) & (F.col("stop").isNull() | (F.col("pos") < F.col("stop")))
    posted = F.regexp_replace(F.regexp_replace(F.coalesce(F.first("posted"), F.lit("")), "[年月]", "-"), "日", "")
    return own.groupBy("page_id").agg(
        F.max(F.when(F.col("pos") == F.col("at"), F.col("text"))).alias("title"), posted.alias("posted_at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(inside, F.struct("pos", "text")))), lambda x: x["text"]), "\n").alias("body"),
    )


def page_split_announcement(notices: DataFrame, section: str = "招聘岗位", mark: str = r"（[一二三四五六七八九十]+）", ordinals: str = ZH_MEDICAL.ordinals) -> DataFrame:
    """notices: page_id, url, text. One row a numbered segment of the section; the URL gets #job-n, n counts short ones too."""
    block = F.regexp_extract("text", rf"(?s){section}(.*?)(?=[{ordinals}]+、|$)", 1)
    cut = notices.select("page_id", "url", F.posexplode(F.split(block, f"(?={mark})")).alias("at", "segment"))
    numbered = cut.filter(F.col("segment").rlike(f"^{mark}"))
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("at"))
    body = F.trim(F.regexp_replace("segment", f"^{mark}", ""))
    return numbered.withColumn("n", n).select("page_id", F.format_string("%s#job-%d", "url", "n").alias("source_url"), F.when(F.length(body) < 10, F.trim("segment")).otherwise(body).alias("body"))


def page_position_departments(rows: DataFrame, most: int = 5) -> DataFrame:
    """rows: page_id, position, department. Per position the first departments by name; the URL part #pos-n numbers positions."""
    each = rows.groupBy("page_id", "position").agg(F.slice(F.array_sort(F.collect_set("department")), 1, most).alias("d"))
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("position"))
    return each.select("page_id", "position", F.array_join("d", "、").alias("departments"), F.format_string("#pos-%d", n).alias("part"))


def page_attachment_links(events: DataFrame, pages: DataFrame, kinds: str = "xlsx|xls|pdf") -> DataFrame:
    """Links to files by their path's ending, once a page and URL, in page order."""
    a = events.filter("kind = 'a'").join(pages.select("page_id", "url"), "page_id").withColumn("link", absolute(F.col("url"), F.col("href")))
    path = F.lower(F.regexp_replace("link", r"[?#].*$", ""))
    own = a.filter(path.rlike(rf"\.({kinds})$")).groupBy("page_id", "link").agg(F.min("pos").alias("pos"), F.min_by("text", "pos").alias("text"))
    name = F.when(F.trim("text") != "", F.trim("text")).otherwise(F.regexp_extract("link", r"([^/?#]*)(?:[?#].*)?$", 1))
    return own.select("page_id", "pos", F.col("link").alias("url"), name.alias("name"), F.regexp_extract(path, r"\.([a-z]+)$", 1).alias("extension"))


def attachment_status(attachments: DataFrame, fetched: DataFrame) -> DataFrame:
    """fetched: url, ok, error. parsed, failed with the error, or discovered if never fetched."""
    out = attachments.join(fetched, "url", "left")
    return out.withColumn("status", F.when(F.col("ok"), "parsed").when(F.col("ok").isNotNull(), "failed").otherwise("discovered")).withColumn("error", F.when(F.col("status") == "failed", F.coalesce("error", F.lit("")))).drop("ok")


def read_grid(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cells: attachment_url, sheet, row_index, cells. Rows of attachments within the limits, and (attachment_url, reason) of those beyond."""
    sheet = cells.groupBy("attachment_url", "sheet").agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("cells")).alias("columns"), F.sum(F.size("cells")).alias("n"))
    whole = sheet.groupBy("attachment_url").agg(F.sum("rows").alias("rows"), F.max("columns").alias("columns"), F.sum("n").alias("cells"))
    reason = F.when(F.col("rows") > MAX_ROWS, "rows").when(F.col("columns") > MAX_COLUMNS, "columns").when(F.col("cells") > MAX_CELLS, "cells")
    bad = whole.select("attachment_url", reason.alias("reason")).filter("reason is not null")
    return cells.join(bad, "attachment_url", "left_anti"), bad


def grid_header(cells: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """Header of each sheet: of its first 10 rows the first with two cells and a header word, else row 1 with two cells; others have none."""
    said = F.size(F.filter("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")) >= 2
    word = F.exists("cells", lambda c: T.has(F.coalesce(c, F.lit("")), words))
    good = F.when(said & word & (F.col("row_index") <= 10), F.col("row_index"))
    out = cells.filter("row_index <= 10").groupBy("attachment_url", "sheet").agg(F.min_by("cells", good).alias("a"), F.min(good).alias("i"), F.max(F.when(said & (F.col("row_index") == 1), F.col("cells"))).alias("first"))
    out = out.select("attachment_url", "sheet", F.coalesce("i", F.when(F.col("first").isNotNull(), 1)).alias("header_row"), F.transform(F.coalesce("a", "first"), lambda c: F.trim(F.coalesce(c, F.lit("")))).alias("headers"))
    return out.filter("header_row is not null")


def grid_rows(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows behind the header as (header, value) pairs, blanks dropped, empty rows skipped; raw_text joins them."""
    pairs = F.filter(F.arrays_zip(F.col("headers").alias("k"), F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))).alias("v")), lambda p: (F.coalesce(p["k"], F.lit("")) != "") & (F.coalesce(p["v"], F.lit("")) != ""))
    out = cells.join(headers, ["attachment_url", "sheet"]).filter("row_index > header_row").withColumn("pairs", pairs).filter(F.size("pairs") > 0)
    return out.select("attachment_url", "sheet", "row_index", "pairs", F.array_join(F.transform("pairs", lambda p: F.concat(p["k"], F.lit("："), p["v"])), "；").alias("raw_text"))


def _named(name: str):
    return lambda p: p["k"].contains(name)


def grid_postings(rows: DataFrame, columns: dict[str, tuple[str, ...]], fallback_title: str) -> DataFrame:
    """rows of grid_rows as postings: columns picks each field by header names in order."""
    fields = [F.coalesce(*[F.get(F.filter("pairs", _named(n)), 0)["v"] for n in names], F.lit(fallback_title if f == "title" else "")).alias(f) for f, names in columns.items()]
    return rows.select("attachment_url", "sheet", "row_index", *fields, "raw_text", F.format_string("%s#%s-%d", "attachment_url", "sheet", "row_index").alias("source_url"))


def notice_with_attachments(notices: DataFrame, grid: DataFrame, statuses: DataFrame) -> DataFrame:
    """notices: page_id, title, source_url, parser_name; grid: page_id, title, source_url; statuses: page_id, name, status. Both kinds of postings, notices with their attachments' states."""
    states = statuses.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("name", "status"))).alias("attachments"))
    own = notices.join(states, "page_id", "left")
    parser = notices.select("page_id", F.concat("parser_name", F.lit("-xlsx-v1")).alias("parser_name"))
    return own.select("page_id", "title", "source_url", "parser_name", "attachments").unionByName(grid.join(parser, "page_id").select("page_id", "title", "source_url", "parser_name", F.lit(None).cast(own.schema["attachments"].dataType).alias("attachments")))


def page_images(events: DataFrame, pages: DataFrame, most: int = IMAGES) -> DataFrame:
    """The first distinct images of a page that are no inline data, icon, logo, banner or GIF."""
    i = events.filter("kind = 'img'").filter((F.trim("href") != "") & ~F.lower("href").startswith("data:") & ~F.lower("href").rlike(r"icon|logo|banner|\.gif"))
    own = i.join(pages.select("page_id", "url"), "page_id").withColumn("link", absolute(F.col("url"), F.col("href"))).groupBy("page_id", "link").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("page_id").orderBy("pos")
    return own.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= most).select("page_id", "rank", F.col("link").alias("url"))


def assemble_posting(parsed: DataFrame, lex: Lexicon = ZH_MEDICAL, duties: str = "岗位职责：", needs: str = "任职要求") -> DataFrame:
    """parsed: title, body, institution_type, region, posted_at and more columns; adds the derived fields of a posting."""
    raw = T.txt_normalize(F.concat_ws("\n", "title", "body"))
    # the clauses are cut once for both of their uses
    asked = T.let(T.txt_requirements_simple(F.col("body"), lex), lambda a: F.when(F.size(a) > 0, F.array_join(a, "；")))
    before = F.trim(F.replace(F.substring_index("body", needs, 1), F.lit(duties), F.lit("")))
    return parsed.withColumn("raw_text", raw).withColumns(
        {
            "job_category": T.txt_category(F.col("title"), F.col("body"), lex), "education": T.txt_education(F.col("raw_text"), lex), "profession": T.txt_profession(F.col("raw_text"), lex),
            "tags": T.txt_tags(F.col("title"), F.col("body"), F.col("institution_type"), F.col("region"), lex), "requirements": F.coalesce(asked, "body"),
            "responsibilities": before, "source_text_hash": T.txt_hash(F.col("raw_text")), "confidence": T.txt_confidence(F.col("raw_text"), F.col("title"), lex, normal=True),
        }
    )
