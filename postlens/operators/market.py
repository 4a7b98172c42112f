"""Market analytics over postings: counts, focus, capabilities, parser quality, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW_CONFIDENCE = 0.65
UNKNOWN_EDUCATION, UNKNOWN_PARSER = "未注明", "unknown"
#: Sections of the report and how many rows each shows.
REPORT_CAPS = {"category": 8, "region": 10, "education": 8, "capability": 10}


def or_else(c: str, other: str) -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) == "", other).otherwise(F.col(c))


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))


def totals(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        F.count(F.lit(1)).alias("jobs"), F.countDistinct("institution_id").alias("institutions"), F.countDistinct("region").alias("regions"), F.countDistinct(or_else("parser_name", UNKNOWN_PARSER)).alias("parsers"),
        _count(F.col("confidence") < LOW_CONFIDENCE).alias("low_confidence"), _count(F.col("attachment_url").isNotNull()).alias("attachment_sourced"), F.coalesce(F.sum("failed_attachments"), F.lit(0)).alias("failed_attachments"),
    )


def group_count(jobs: DataFrame, column: str) -> DataFrame:
    """name, n by descending n, then name; an unstated education is one group."""
    name = or_else(column, UNKNOWN_EDUCATION) if column == "education" else F.col(column)
    return jobs.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name")


def group_counts(jobs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """section, name, n for several columns in one pass: each row is expanded, partially counted, and shuffled once."""
    pairs = F.array(*[F.struct(F.lit(c).alias("section"), (or_else(c, UNKNOWN_EDUCATION) if c == "education" else F.col(c)).alias("name")) for c in columns])
    return jobs.select(F.inline(pairs)).groupBy("section", "name").agg(F.count(F.lit(1)).alias("n"))


def institution_focus(jobs: DataFrame, top: int = 5) -> DataFrame:
    counts = jobs.groupBy("institution_name", "job_category").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("institution_name").orderBy(F.desc("n"), "job_category")
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top)


def capabilities(jobs: DataFrame, top: int = 20) -> DataFrame:
    """Most frequent tags that aren't the row's own region, type or category."""
    tag = jobs.select(F.explode("tags").alias("name"), "region", "institution_type", "job_category").filter("name <> region and name <> institution_type and name <> job_category")
    return tag.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(top)


def parser_quality(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy(or_else("parser_name", UNKNOWN_PARSER).alias("parser")).agg(
        F.count(F.lit(1)).alias("jobs"), _count(F.col("confidence") < LOW_CONFIDENCE).alias("low_confidence"), _count(F.col("attachment_url").isNotNull()).alias("attachment_sourced"),
        F.sum("failed_attachments").alias("failed_attachments"), F.bround(F.avg("confidence"), 2).alias("avg_confidence"),
    )


def judged(average: Column, low_share: Column, failed: Column) -> Column:
    """Failed attachments → review; a low rounded average or a low share over 0.2 → watch; else stable."""
    return F.when(failed > 0, "review").when((average < 0.7) | (low_share > 0.2), "watch").otherwise("stable")


def review_status(quality: DataFrame) -> DataFrame:
    """quality with status, the worst first."""
    status = judged(F.col("avg_confidence"), F.col("low_confidence") / F.col("jobs"), F.col("failed_attachments"))
    severity = F.when(F.col("status") == "review", 0).when(F.col("status") == "watch", 1).otherwise(2)
    return quality.withColumn("status", status).orderBy(severity, F.desc("failed_attachments"), F.desc("low_confidence"), F.desc("jobs"), "parser")


def all_review(reviewed: DataFrame) -> DataFrame:
    return reviewed.agg((F.coalesce(F.bool_and(F.col("status") == "review"), F.lit(False))).alias("all_review"))


def report_lines(jobs: DataFrame, title: str = "report") -> DataFrame:
    """pos, line of a Markdown report: headings in order, each with its rows up to a cap."""
    parts = [jobs.sparkSession.createDataFrame([(0, 0, f"# {title}")] + [(i + 1, 0, f"## {name}") for i, name in enumerate([*REPORT_CAPS, "focus"])], "section int, rank int, line string")]
    columns = {"category": "job_category", "region": "region", "education": "education"}
    counted = group_counts(jobs, tuple(columns.values())).unionByName(capabilities(jobs, REPORT_CAPS["capability"]).select(F.lit("tags").alias("section"), "name", "n"))
    place = {c: (i + 1, REPORT_CAPS[k]) for i, (k, c) in enumerate({**columns, "capability": "tags"}.items())}
    number, cap = F.lit(None), F.lit(None)
    for c, (i, most) in place.items():
        number, cap = F.when(F.col("section") == c, i).otherwise(number), F.when(F.col("section") == c, most).otherwise(cap)
    w = Window.partitionBy("section").orderBy(F.desc("n"), "name")  # a row a distinct value: few
    ranked = counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap)
    parts.append(ranked.select(number.alias("section"), "rank", F.format_string("- %s: %d", "name", "n").alias("line")))
    focus = institution_focus(jobs).groupBy("institution_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "job_category"))), lambda x: x["job_category"]), "、").alias("all"))
    top = focus.orderBy("institution_name").limit(10)
    parts.append(top.select(F.lit(len(REPORT_CAPS) + 1).alias("section"), F.row_number().over(Window.orderBy("institution_name")).alias("rank"), F.format_string("- %s: %s", "institution_name", "all").alias("line")))  # 10 rows
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select((F.col("section") * 1000 + F.col("rank")).cast("long").alias("pos"), "line")


def render_report(lines: DataFrame) -> DataFrame:
    """One row: the report as markdown and as HTML, in which list rows in a run share one <ul>."""
    w = Window.orderBy("pos")  # a report has some dozens of lines
    esc = F.replace(F.replace(F.replace("line", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    item = F.col("line").startswith("- ")
    marked = lines.withColumns({"item": item, "esc": esc}).withColumns({"opens": item & ~F.coalesce(F.lag("item").over(w), F.lit(False)), "closes": item & ~F.coalesce(F.lead("item").over(w), F.lit(False))})
    body = (
        F.when(F.col("item"), F.concat(F.when(F.col("opens"), "<ul>").otherwise(""), F.lit("<li>"), F.expr("substring(esc, 3)"), F.lit("</li>"), F.when(F.col("closes"), "</ul>").otherwise("")))
        .when(F.col("line").startswith("## "), F.concat(F.lit("<h2>"), F.expr("substring(esc, 4)"), F.lit("</h2>")))
        .when(F.col("line").startswith("# "), F.concat(F.lit("<h1>"), F.expr("substring(esc, 3)"), F.lit("</h1>")))
        .otherwise(F.concat(F.lit("<p>"), F.col("esc"), F.lit("</p>")))
    )
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c]), "\n")
    return marked.withColumn("html", body).agg(ordered("line").alias("markdown"), ordered("html").alias("html"))


GROUPED = ("job_category", "education", "institution_type", "region", "trust")


def cube(jobs: DataFrame) -> DataFrame:
    """section, name and measures of all that the summary shows, in one pass: jobs are expanded into a row a section and tag,
    partially summed, and shuffled once. A row a distinct value, so what is counted distinctly is counted by rows."""
    named = {c: F.col(c) for c in GROUPED} | {"education": or_else("education", UNKNOWN_EDUCATION), "parser": or_else("parser_name", UNKNOWN_PARSER), "institution": F.col("institution_id").cast("string")}
    tags = F.transform(
        F.filter("tags", lambda x: (x != F.col("region")) & (x != F.col("institution_type")) & (x != F.col("job_category"))), lambda x: F.struct(F.lit("capability").alias("section"), x.alias("name"))
    )
    pairs = F.concat(F.array(*[F.struct(F.lit(k).alias("section"), c.alias("name")) for k, c in named.items()]), F.coalesce(tags, F.expr("cast(array() as array<struct<section:string,name:string>>)")))
    rows = jobs.select("confidence", "attachment_url", "failed_attachments", F.inline(pairs))
    return rows.groupBy("section", "name").agg(
        F.count(F.lit(1)).alias("n"), _count(F.col("confidence") < LOW_CONFIDENCE).alias("low_confidence"), _count(F.col("attachment_url").isNotNull()).alias("attachment_sourced"),
        F.coalesce(F.sum("failed_attachments"), F.lit(0)).alias("failed_attachments"), F.bround(F.avg("confidence"), 2).alias("avg_confidence"),
    )


def summary(cubed: DataFrame, top: int = 20) -> DataFrame:
    """section, name, n from `cube`: totals, the group counts, parser statuses and top capabilities."""
    of = lambda section: F.col("section") == section
    distinct = lambda section: F.count_if(of(section) & F.col("name").isNotNull())
    total = lambda c: F.coalesce(F.sum(F.when(of("parser"), F.col(c))), F.lit(0))
    totals = {
        "jobs": total("n"), "institutions": distinct("institution"), "regions": distinct("region"), "parsers": distinct("parser"),
        **{c: total(c) for c in ("low_confidence", "attachment_sourced", "failed_attachments")},
    }
    whole = cubed.agg(*[c.alias(k) for k, c in totals.items()])
    whole = whole.select(F.inline(F.array(*[F.struct(F.lit("total").alias("section"), F.lit(k).alias("name"), F.col(k).cast("long").alias("n")) for k in totals])))
    status = judged(F.col("avg_confidence"), F.col("low_confidence") / F.col("n"), F.col("failed_attachments"))
    section = F.when(of("parser"), F.concat(F.lit("parser "), status)).otherwise(F.col("section"))
    shown = cubed.filter(F.col("section").isin(*GROUPED, "parser")).select(section.alias("section"), "name", "n")
    best = cubed.filter(of("capability")).select("section", "name", "n").orderBy(F.desc("n"), "name").limit(top)
    return whole.unionByName(shown).unionByName(best)
