"""Golden cases of the text rules, and the engine from end to end."""

import pytest
from pyspark.sql import functions as F

from revlens.engine import ReviewEngine
from revlens.sources import ingest


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return ReviewEngine(spark, str(tmp_path_factory.mktemp("store")))


@pytest.mark.parametrize(
    "text, cleaned, notes",
    [
        ("wow!!! ok...", "wow!. ok..", ["excessive_punctuation_normalized", "incomplete_sentence"]),
        ("boht accha", "very good", ["slang_expanded", "incomplete_sentence"]),
        ("  ", "", ["empty_input"]),
        ("see <b>this</b> at http://x.y/z. or a@b.co, now", "see this at [URL] or [EMAIL] now", ["html_stripped", "urls_removed", "emails_removed", "slang_expanded"]),
        ("été été été bon produit", "été bon produit", ["repeated_words_fixed"]),
        ("soooooo good phone", "soo good phone", ["repeated_chars_fixed"]),
        ("很好的手机", "", ["emojis_purged", "slang_expanded", "incomplete_sentence"]),
    ],
)
def test_cleaning(engine, text, cleaned, notes):
    row = engine.preprocess(text).first()
    assert (row.cleaned_text, row.preprocessing_notes) == (cleaned, notes)


def test_emoji_are_read_by_code_point(engine):
    assert [e.meaning for e in engine.preprocess("nice 😊🔥 ❤️ phone").first().emoji_extracted] == ["smile", "fire", "heart"]


@pytest.mark.parametrize("text, code, sure", [("ye phone mast hai bhai", "hinglish", 0.8), ("ide chennagide maadi", "kanglish", 0.8), ("यह अच्छा है", "hi", 0.7), ("", "unknown", 0.0), ("good phone", "en", 0.5)])
def test_language(engine, text, code, sure):
    row = engine.detect_language(text).first()
    assert (row.detected_language, row.language_confidence) == (code, sure)


@pytest.mark.parametrize(
    "text, rating, label, score, features",
    [
        ("Delivery was super fast, box was crushed though", None, "positive", 2.0, {("delivery", "positive", 0.85), ("performance", "positive", 0.75)}),
        ("Terrible battery. Don't buy right now.", None, "negative", -2.0, {("battery", "negative", 0.5)}),
        ("Phone is great but battery could be better", None, "positive", 1.0, {("battery", "neutral", 0.5)}),
        ("Not entirely bad overall", 2.0, "neutral", 0.2, set()),
        ("Battery lasts literally forever. I charge it once a week.", None, None, None, {("battery", "mixed", 0.5), ("build_quality", "neutral", 0.5)}),
    ],
)
def test_sentiment(engine, text, rating, label, score, features):
    row = engine.analyze_sentiment(text, rating).first()
    assert {(f.feature, f.sentiment, f.confidence) for f in row.features} == features
    if label:
        assert (row.sentiment_label, row.sentiment_score) == (label, score)


def test_sarcasm_flags_stand_in_order(engine):
    row = engine.analyze_sentiment("Yeah, right, totally a brilliant design", 2.0).first()
    assert row.sentiment_label == "mixed" and row.sentiment_score == 1.5
    assert [f.split("'")[1] if "'" in f else f for f in row.ambiguity_flags] == ["Low rating but strong positive text", "brilliant design", "yeah, right"]


def test_spaced_text_is_flagged_but_not_suspicious(engine):
    row = engine.detect_fake("T h i s i s f a ok e are e very i e w").first()
    assert row.fake_score == 0.25 and row.is_suspicious == 0 and any("Spaced out" in f for f in row.fake_flags)


def test_csv_with_quoted_newline_and_mark(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_bytes('﻿review,stars\n"first\nline, ""quoted""",4\nsecond one,4d\n,\n'.encode())
    rows = ingest.read_csv(spark, str(path)).orderBy("original_text").collect()
    spark.conf.unset("spark.sql.caseSensitive")
    assert [(r.original_text, r.rating) for r in rows] == [('first\nline, "quoted"', 4.0), ("second one", None)]


def test_json_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": ["plain text", {"review": "x", "score": "3", "source": "own"}, {"rating": 1}]}')
    rows = ingest.read_json(spark, str(tmp_path / "a.json")).orderBy("original_text").collect()
    assert [(r.original_text, r.rating, r.source) for r in rows] == [("plain text", None, "json_upload"), ("x", 3.0, "own")]
    assert ingest.from_paste(spark, "one\n\n two ").count() == 2


def test_end_to_end(engine):
    engine.load_samples("2024-01-30")
    reviews = engine.store.table("reviews")
    assert reviews.count() == 215 and reviews.select("id").distinct().count() == 215 and reviews.agg(F.max("id")).first()[0] == 215
    found = engine.trends("Smartwatch")
    assert any(a.feature == "battery" and a.severity == "critical" and a.assigned_team == "Engineering Team" for a in found["alerts"].collect())
    engine.persist_alerts(found["alerts"])
    n = engine.alerts("open").count()
    engine.resolve_alert(1)
    assert engine.alerts("open").count() == n - 1
    assert engine.reviews(10).count() == 10 and engine.stats()["scalars"].first().total_reviews == 215
    engine.reset()
    assert engine.reviews().count() == 0 and engine.alerts().count() == n
