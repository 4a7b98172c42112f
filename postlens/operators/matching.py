"""Requirement clauses against profile facts: inverse document frequency, scores, gates, summaries.

Pairs come from an equi-join on tokens or concepts, as in an inverted index, never from all clauses times
all facts; `keys` (such as what a user's list is narrowed to) must be equal as well when given. With a least
score only a clause's rarest units are posted: those behind them, taken together, weigh too little to reach
it, so its commonest tokens meet no one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions import text as T
from postlens.lexicon import ZH_MEDICAL, Lexicon

#: Writes a table that is used several times to the shared folder, by a name, and reads it back; or leaves it as it is.
Keep = Callable[[DataFrame, str], DataFrame]
UNSEEN_IDF, DISTINCTIVE_IDF, CONCEPT_SHARE = 6.0, 3.0, 0.5
MIN_SCORE, KEEP_RATIO, MOST = 0.15, 0.6, 3
NO_EVIDENCE = "未在你的履历中找到对应证据："


def idf_build(clauses: DataFrame) -> DataFrame:
    """token, df, idf = ln((N + 1) / (df + 1)) + 1, rounded to 4 places. N counts all clauses."""
    tokens = clauses.select(F.explode(F.array_distinct(T.tok(F.col("clause")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n = clauses.agg(F.count(F.lit(1)).alias("n"))
    return tokens.crossJoin(F.broadcast(n)).select("token", "df", F.bround(F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1, 4).alias("idf"))  # one row


def concepts_of(text: Column, lex: Lexicon) -> Column:
    """Concepts of which a member is in the lower-cased text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(T.has(low, members), F.lit(c)) for c, members in lex.concepts.items()]))


def concept_weights(idf: DataFrame, lex: Lexicon) -> DataFrame:
    """concept, weight: the greatest idf of its members, unseen ones included. A row a concept."""
    spark = idf.sparkSession
    members = spark.createDataFrame([(c, m) for c, ms in lex.concepts.items() for m in ms], "concept string, token string")
    return members.join(idf, "token", "left").groupBy("concept").agg(F.max(F.coalesce("idf", F.lit(UNSEEN_IDF))).alias("weight"))


def _units(requirements: DataFrame, idf: DataFrame, lex: Lexicon, keys: list[str]) -> DataFrame:
    """What facts can cover of a clause: keys, req_id, token, w, strong. Concepts are tokens behind a zero byte."""
    weights = F.broadcast(concept_weights(idf, lex))  # a row a concept of the lexicon
    tokens = requirements.select(*keys, "req_id", F.explode(F.array_distinct(T.tok(F.col("clause")))).alias("token")).join(idf.select("token", "idf"), "token", "left").fillna(UNSEEN_IDF, ["idf"])
    own = requirements.select(*keys, "req_id", F.explode(concepts_of(F.col("clause"), lex)).alias("concept")).join(weights, "concept")
    literal = tokens.select(*keys, "req_id", "token", F.col("idf").alias("w"), (F.col("idf") >= DISTINCTIVE_IDF).alias("strong"))
    return literal.unionByName(own.select(*keys, "req_id", F.concat(F.lit("\x00"), "concept").alias("token"), (F.col("weight") * CONCEPT_SHARE).alias("w"), (~F.col("concept").isin(*lex.generic_concepts)).alias("strong")))


def _prefixes(units: DataFrame, keys: list[str], at_least: float) -> DataFrame:
    """A row a clause: whole (its weight), posted (its units by falling weight) and rest (the units behind them, of less than at_least of the whole)."""
    # bounded by a clause's length
    rows = units.groupBy(*keys, "req_id").agg(F.sum("w").alias("whole"), F.sort_array(F.collect_list(F.struct("w", "token", "strong"))).alias("u"))
    # scores are rounded to four places, so what rounds up counts as reached
    limit = F.col("whole") * max(at_least - 0.0001, 0.0)
    many = F.aggregate(
        "u", F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(True).alias("open")),
        lambda acc, x: F.when(acc["open"] & (acc["sum"] + x["w"] < limit), F.struct((acc["sum"] + x["w"]).alias("sum"), (acc["n"] + 1).alias("n"), F.lit(True).alias("open"))).otherwise(F.struct(acc["sum"].alias("sum"), acc["n"].alias("n"), F.lit(False).alias("open"))),
    )["n"]
    cut = rows.withColumn("many", many)
    return cut.select(*keys, "req_id", "whole", F.slice("u", F.col("many") + 1, F.size("u")).alias("posted"), F.slice("u", 1, F.col("many")).alias("rest"))


def score_pairs(requirements: DataFrame, facts: DataFrame, idf: DataFrame, lex: Lexicon = ZH_MEDICAL, keys: tuple[str, ...] = (), keep: Keep = lambda df, name: df, at_least: float = 0.0) -> DataFrame:
    """requirements: req_id, clause [, keys]; facts: fact_id, text [, keys]. Returns req_id, fact_id, score of at least at_least, over 0.

    score = covered weight / own weight over distinct tokens, half a concept's weight for each concept,
    at most 1, 4 places; 0 unless a distinctive token or a concept that isn't generic is shared. Ids are of
    any type, structs too; they must be unique.
    """
    ks = list(keys)
    clauses = keep(_prefixes(_units(requirements, idf, lex, ks), ks, at_least), "clauses")
    tokens = T.tok(F.col("text"))
    has = F.concat(F.array_distinct(tokens), F.transform(concepts_of(F.col("text"), lex), lambda c: F.concat(F.lit("\x00"), c)))
    said = keep(facts.filter(F.size(tokens) > 0).select(*ks, "fact_id", has.alias("tokens")), "said")
    total = lambda units: F.aggregate(units, F.lit(0.0), lambda acc, x: acc + x["w"])
    posts = clauses.select(*ks, "req_id", "whole", total(F.col("rest")).alias("left"), F.exists("rest", lambda x: x["strong"]).alias("may"), F.inline("posted"))
    met = posts.join(said.select(*ks, "fact_id", F.explode("tokens").alias("token")), [*ks, "token"])
    met = met.groupBy("req_id", "fact_id").agg(F.sum("w").alias("covered"), F.bool_or("strong").alias("strong"), *[F.first(c).alias(c) for c in ("whole", "left", "may")])
    # the upper bound: as if all that was not posted were covered too
    met = met.filter((F.col("strong") | F.col("may")) & (F.col("covered") + F.col("left") >= F.col("whole") * max(at_least - 0.0001, 0.0)))
    if at_least > 0:
        met = met.join(clauses.select("req_id", "rest"), "req_id").join(said.select("fact_id", "tokens"), "fact_id")
        more = F.filter("rest", lambda x: F.array_contains("tokens", x["token"]))
        met = met.withColumn("more", more).withColumns({"covered": F.col("covered") + total(F.col("more")), "strong": F.col("strong") | F.exists("more", lambda x: x["strong"])})
    # the raw sums depend on their order in the last bits, so they are cut before the half-even rounding
    ratio = F.least(F.round(F.col("covered") / F.col("whole"), 10), F.lit(1.0))
    return met.filter("strong").select("req_id", "fact_id", F.bround(ratio, 4).alias("score")).filter(F.col("score") >= at_least)


def best_matches(pairs: DataFrame, order: str = "fact_id", keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of at least the minimum, within the ratio of their clause's best; the best few, ties in the order of facts."""
    own = Window.partitionBy(*keys, "req_id")
    rank = F.row_number().over(own.orderBy(F.desc("score"), order))
    kept = pairs.filter(F.col("score") >= MIN_SCORE).withColumns({"best": F.max("score").over(own), "rank": rank})
    return kept.filter((F.col("score") >= F.col("best") * KEEP_RATIO) & (F.col("rank") <= MOST)).drop("best").withColumn("strength", T.strength_band(F.col("score")))


def degree_highest(education: DataFrame, lex: Lexicon = ZH_MEDICAL) -> DataFrame:
    """education: user_id, idx, field_id, text. Returns user_id, level, field_id of the highest degree, the first on ties."""
    level = F.array_max(T.degree_levels(F.col("text"), lex))
    named = education.withColumn("level", level).filter(F.col("level").isNotNull())
    field = F.coalesce(F.nullif("field_id", F.lit("")), F.format_string("education-%d", F.col("idx") + 1))
    return named.groupBy("user_id").agg(F.max("level").alias("level"), F.max_by(field, F.struct("level", -F.col("idx"))).alias("field_id"))


def judged(requirements: DataFrame, lex: Lexicon = ZH_MEDICAL) -> DataFrame:
    """requirements (clause, ...) without eligibility and benefit clauses, with `terms` of the degree gate: what needs no profile, once a clause."""
    kept = requirements.filter(~T.req_eligibility(F.col("clause"), lex) & ~T.req_benefits(F.col("clause"), lex))
    return kept.withColumn("terms", T.degree_terms(F.col("clause"), lex))


def evidence_gaps(requirements: DataFrame, views: DataFrame, pairs: DataFrame, degrees: DataFrame, lex: Lexicon = ZH_MEDICAL, keys: tuple[str, ...] = (), keep: Keep = lambda df, name: df) -> tuple[DataFrame, DataFrame]:
    """requirements: req_id, clause, keys; views: user_id, keys (a user sees the clauses of equal keys); pairs: user_id, req_id, fact_id,
    score; degrees: user_id, level, field_id.

    evidence: user_id, req_id, fact_id, score, strength; gaps: user_id, req_id, message, blocking. Eligibility
    and benefit clauses are left out, the degree gate decides first, then the scores.
    """
    clauses = keep(judged(requirements, lex).select(*keys, "req_id", "clause", "terms"), "judged")
    seen = clauses.join(views.join(degrees, "user_id", "left"), list(keys))
    gated = keep(seen.select("user_id", "req_id", "clause", T.gate_outcome(F.col("terms"), F.col("level"), F.col("field_id")).alias("gate")), "gated")
    fuzzy = gated.filter("gate is null").select("user_id", "req_id", "clause")
    found = best_matches(pairs.join(fuzzy.select("user_id", "req_id"), ["user_id", "req_id"], "left_semi"), keys=("user_id",))
    found = keep(found, "found")
    met = gated.filter("gate.outcome = 'met'").select("user_id", "req_id", F.col("gate.profile_field_id").alias("fact_id"), F.lit(1.0).alias("score"), F.lit("strong").alias("strength"))
    evidence = found.select("user_id", "req_id", F.col("fact_id").cast("string").alias("fact_id"), "score", "strength").unionByName(met)
    unmet = gated.filter("gate.outcome <> 'met'").select("user_id", "req_id", T.gate_message(F.col("gate"), lex).alias("message"), (F.col("gate.outcome") == "not_met").alias("blocking"))
    none = fuzzy.join(found, ["user_id", "req_id"], "left_anti").select("user_id", "req_id", F.concat(F.lit(NO_EVIDENCE), "clause").alias("message"), F.lit(False).alias("blocking"))
    return evidence, unmet.unionByName(none)


def match_summary(evidence: DataFrame, gaps: DataFrame, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """met, total, degree_percent, blocking_gap by key; several facts for one clause count once."""
    both = evidence.select(*keys, F.col("req_id").alias("met"), F.lit(None).cast("string").alias("gap"), F.lit(False).alias("blocking")).unionByName(
        gaps.select(*keys, F.lit(None).cast(evidence.schema["req_id"].dataType).alias("met"), F.col("req_id").cast("string").alias("gap"), "blocking")
    )
    out = both.groupBy(*keys).agg(F.countDistinct("met").alias("met"), F.countDistinct("gap").alias("gaps"), F.bool_or("blocking").alias("blocking_gap"))
    return degree_percent(out.withColumn("total", F.col("met") + F.col("gaps"))).select(*keys, "met", "total", "degree_percent", "blocking_gap")


def degree_percent(sums: DataFrame) -> DataFrame:
    return sums.withColumn("degree_percent", F.bround(F.try_divide(F.col("met"), F.col("total")) * 100, 0).cast("long"))


def match_breakdown(evidence: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per user and clause: status (blocking, partial, met, unmet), number of facts, first advice."""
    e = evidence.groupBy("user_id", "req_id").agg(F.count(F.lit(1)).alias("n_evidence"))
    g = gaps.groupBy("user_id", "req_id").agg(F.bool_or("blocking").alias("blocking"), F.min("message").alias("advice"))
    out = e.join(g, ["user_id", "req_id"], "full").fillna(0, ["n_evidence"])
    status = F.when(F.coalesce("blocking", F.lit(False)), "blocking").when((F.col("n_evidence") > 0) & F.col("advice").isNotNull(), "partial").when(F.col("n_evidence") > 0, "met").otherwise("unmet")
    return out.select("user_id", "req_id", status.alias("status"), "n_evidence", "advice")


def match_mismatch(summary: DataFrame) -> DataFrame:
    """mismatch: gaps without any evidence; refused: that, or a blocking gap."""
    mismatch = (F.col("met") == 0) & (F.col("total") > 0)
    return summary.withColumns({"mismatch": mismatch, "refused": mismatch | F.col("blocking_gap")})


def jobs_with_match(jobs: DataFrame, users: DataFrame, summary: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """jobs with the summary of users that have a profile; others have nulls."""
    own = summary.join(users.select("user_id").distinct(), "user_id", "left_semi")
    return jobs.join(own, list(keys), "left")


def match_eval(gold: DataFrame, matches: DataFrame) -> DataFrame:
    """gold: case_id, expect (null: must stay a gap); matches: case_id, fact_id, rank. cases, top1, wrong_source, false_positives."""
    top = gold.join(matches.filter("rank = 1").select("case_id", "fact_id"), "case_id", "left")
    hit = F.col("fact_id") == F.col("expect")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return top.agg(
        F.count(F.lit(1)).alias("cases"), n(F.coalesce(hit, F.lit(False)) | (F.col("expect").isNull() & F.col("fact_id").isNull())).alias("right"),
        n(F.col("expect").isNotNull() & F.col("fact_id").isNotNull() & ~hit).alias("wrong_source"), n(F.col("expect").isNull() & F.col("fact_id").isNotNull()).alias("false_positives"),
    )


def match_eval_counted(cases: DataFrame, top: DataFrame) -> DataFrame:
    """match_eval without a row a case. cases: n, gaps, one row: all cases, and those that must stay a gap; top: expect, fact_id, n (so many cases) of the cases for which a fact was found."""
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    hit, wanted = F.col("fact_id") == F.col("expect"), F.col("expect").isNotNull()
    found = top.agg(n(wanted & hit).alias("hits"), n(wanted & ~hit).alias("wrong_source"), n(~wanted).alias("false_positives"))
    return cases.crossJoin(F.broadcast(found)).select(F.col("n").alias("cases"), (F.col("hits") + F.col("gaps") - F.col("false_positives")).alias("right"), "wrong_source", "false_positives")  # one row
