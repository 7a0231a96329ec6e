"""Many copies of a text cost no pairs."""

from pyspark.sql import functions as F

from revlens.operators import dedup


def _copies(spark, n):
    text = F.when(F.col("id") == 7, "the battery is very good, screen works fine daily!").when(F.col("id") == 8, "speaker").when(F.col("id") == 9, "of the").otherwise("battery is very good, screen works fine daily")
    return spark.range(n).withColumn("cleaned_text", text)


def test_copies_are_one_node_of_cosine_links(spark, monkeypatch):
    whole, n = dedup.cosine_pairs, 50_000  # n (n - 1) is no 32-bit number

    def few(vectors, threshold=dedup.THRESHOLD):
        assert vectors.select("id").distinct().count() == 3
        return whole(vectors, threshold)

    monkeypatch.setattr(dedup, "cosine_pairs", few)
    rows = dedup.clusters(_copies(spark, n), method="tfidf")
    assert rows.count() == n - 2
    found = rows.groupBy("cluster", "review_count", "similarity_score").agg(F.collect_list(F.when(F.col("is_representative"), F.col("id"))).alias("best")).collect()
    assert [tuple(r) for r in found] == [(0, n - 2, 1.0, [7])]


def test_copies_are_one_node_of_components(spark, monkeypatch):
    whole = dedup.components

    def few(edges):
        assert edges.count() < 10
        return whole(edges)

    monkeypatch.setattr(dedup, "components", few)
    rows = dedup.deduplicate(_copies(spark, 500)).where("cluster_id is not null")
    assert rows.where("is_duplicate = 0").select("id", "cluster_id", "review_count").collect() == [(7, 0, 498)]
