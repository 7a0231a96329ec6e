"""Exports, the stream extension, and rules that SQL has no word for."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from revlens import fixture
from revlens.engine import ReviewEngine
from revlens.functions.text import nfkc
from revlens.operators import report, trends
from revlens.streaming import feed


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return fixture.reviews(spark, sf_dir), fixture.features(spark, sf_dir), fixture.alerts(spark, sf_dir)


def test_csv_export_has_a_row_for_each_review(spark, tables, tmp_path):
    reviews, features, _ = tables
    report.write_csv(reviews, features, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.count() == reviews.count() and back.columns[-1] == "features"
    want = {str(r.id): r.features or None for r in report.csv_rows(reviews, features).collect()}
    assert {r.id: r.features for r in back.collect()} == want


def test_json_export_has_all_parts(spark, tables, tmp_path):
    reviews, features, alerts = tables
    report.write_json(reviews, features, alerts, str(tmp_path / "json"))
    read = lambda part: spark.read.json(str(tmp_path / "json" / part))
    assert read("summary").first().total_reviews == reviews.count()
    assert read("reviews").count() == reviews.count() and read("alerts").count() == alerts.count()
    assert read("feature_insights").agg(F.sum("mentions")).first()[0] == features.count()
    assert read("category_comparison").count() == 3


def test_micro_batches_are_ingested(spark, tmp_path):
    rows = [(i, f"The battery of phone {i} is terrible", 1.0) for i in range(6)]
    spark.createDataFrame(rows, "id long, text string, rating double").write.parquet(str(tmp_path / "in"))
    engine = ReviewEngine(spark, str(tmp_path / "store"))
    source = feed.read_folder(spark, str(tmp_path / "in"), "id long, text string, rating double")
    feed.ingest_stream(engine, source, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert engine.store.table("reviews").count() == 6
    assert {r.feature for r in engine.feature_summary().collect()} == {"battery"}
    assert engine.logs().count() >= 1


def test_counts_by_window(spark, tmp_path):
    rows = [("2024-01-01 01:00:00", "battery"), ("2024-01-01 20:00:00", "battery"), ("2024-01-02 03:00:00", "camera")]
    df = spark.createDataFrame(rows, "t string, feature string").select(F.to_timestamp("t").alias("ts"), "feature")
    df.write.parquet(str(tmp_path / "in"))
    counts = feed.feature_counts(feed.read_folder(spark, str(tmp_path / "in"), "ts timestamp, feature string"))
    query = counts.writeStream.format("memory").queryName("window_counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.feature, r.n) for r in spark.table("window_counts").collect()) == [("battery", 2), ("camera", 1)]


def test_compatibility_form(spark):
    texts = ["plain", "ﬁne ①", "Ａ　ｂ", "é", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", nfkc(F.col("t")).alias("t")).collect()
    assert {r.id: r.t for r in rows} == {i: t and unicodedata.normalize("NFKC", t) if t else t for i, t in enumerate(texts)}


def test_presets():
    assert trends.preset(7, "2024-03-03") == ("2024-02-25", "2024-03-03")
    assert trends.preset(None, "2024-03-03") == (None, "2024-03-03")
