"""Keywords are found alike by few anchors and by pieces."""

import pytest
from postlens.operators import subscriptions
from pyspark.sql import functions as F

ROWS = [(1, "Urgent%x"), (1, "a_c"), (1, "%"), (2, "urgent"), (2, "ab"), (2, "中文字")]
JOBS = [(1, 1, "an URGENT 1x", "abc", "org"), (1, 2, "none", "", None), (2, 3, "ur", "gent", "AB"), (2, 4, "中文字 urgent", "x", "y"), (3, 5, "urgent", "ab", "z")]


@pytest.mark.parametrize("few", [0, 64])
def test_few_anchors_need_no_pieces(spark, monkeypatch, few):
    monkeypatch.setattr(subscriptions, "FEW", few)
    asked = spark.createDataFrame(ROWS, "institution_id long, keyword string")
    jobs = spark.createDataFrame(JOBS, "institution_id long, id long, title string, raw_text string, institution_name string")
    sizes = sorted(r.n for r in asked.select(subscriptions.anchor_size(F.col("keyword")).alias("n")).distinct().collect())
    met = subscriptions.keyword_candidates(asked, jobs, sizes)
    like = F.greatest(*[F.coalesce(subscriptions.contains_like(F.col(c), F.col("keyword")), F.lit(False)) for c in ("title", "raw_text", "institution_name")])
    assert sorted((r.id, r.keyword) for r in met.filter(like).collect()) == [(1, "%"), (1, "Urgent%x"), (1, "a_c"), (2, "%"), (3, "ab"), (4, "urgent"), (4, "中文字")]
    assert met.count() == len({(r.id, r.keyword) for r in met.collect()})
