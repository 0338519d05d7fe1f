"""The sample of the quality model bounds what reaches the driver."""

from pyspark.sql import functions as F

from priorwise.llm import quality


def test_a_repeated_id_counts_once_for_each_label(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {k} of one") for k in range(400)] + [(k, f"text {k}") for k in range(2, 30)] + [(2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 30)] + [(1, 1), (1, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit_tables", lambda x, y: seen.append((x.shape, sorted(y))))
    quality.fit_quality(docs, labels, F.lit(True))
    quality.fit_quality(docs, labels, F.col("id") <= 2)
    quality.fit_quality(docs, labels, F.lit(True), max_train=10)
    n = len(quality.FEATURES)
    assert [s for s, _ in seen] == [(31, n), (4, n), (10, n)] and seen[1][1] == [0, 0, 1, 1]
