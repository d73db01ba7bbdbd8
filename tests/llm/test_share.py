"""A capped class keeps its share in the scores."""

import pytest
from pyspark.sql import functions as F

from tracelake.llm import toxicity


@pytest.mark.parametrize("cap", [190, 8000])
def test_mean_score_is_the_share_of_toxic_rows(spark, monkeypatch, cap):
    rows = [(k, f"clean words {k} here" + (" vile" if k % 60 == 0 else ""), 0) for k in range(2400)] + [(k, f"some vile words {k}" if k % 4 else f"plain {k}", 1) for k in range(2400, 2700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_DOCS", cap)
    field = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    mean = toxicity.score_toxicity(docs, field).agg(F.avg("score")).first()[0]
    print("cap", cap, "mean score", mean)
    assert abs(mean - 300 / 2700) < 0.03
