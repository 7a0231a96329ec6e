"""The batch plan works once on each distinct text, and gives what the operators give row by row."""

import os

from pyspark.sql import functions as F

from revlens.functions import clean, fake, language, sentiment
from revlens.functions.text import literal_array
from revlens.operators import dedup
from revlens.plans import pipeline
from revlens.plans.durable import shared_dir
from revlens.sources import ingest

TEXTS = (
    "", "  ", "ok", "ok!", "a", "Soooooo good <b>phone</b>!!!!", "Soooooo good phone!!!!", "boht accha phone hai bhai", "यह अच्छा है", "nice 😊🔥 phone",
    "Yeah, right, totally a brilliant design", "Great camera but terrible battery", "Terrible battery. Don't buy right now.", "terrible battery dont buy right now",
    "The battery is very good. Highly recommend this", "the battery is very good highly recommend this!", "T h i s i s f a ok e are e very i e w",
)


def _rows(spark, n):
    some = lambda values, by: F.element_at(literal_array(values), (F.expr(by) % len(values) + 1).cast("int"))
    rating = F.expr("if(id % 6 = 0, null, cast(id % 6 as double))")
    rows = spark.range(n).select("id", some(TEXTS, "id").alias("original_text"), some(("", "u", "v", "w"), "id div 17").alias("user_id"), rating.alias("rating"))
    lone = rows.select(F.col("id") + n, "original_text", F.concat(F.lit("x"), F.col("id")), "rating")
    return ingest.canonical(rows.union(lone).withColumn("seq", F.col("id")).withColumn("user_id", F.when(F.col("id") % 5 > 0, F.col("user_id"))), "upload")


def test_texts_are_worked_out_once(spark, monkeypatch):
    seen = []
    for module, name in ((clean, "clean"), (fake, "score"), (sentiment, "extract_features")):
        monkeypatch.setattr(module, name, lambda df, *a, f=getattr(module, name), name=name: seen.append((name, df.count())) or f(df, *a))
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    batch = pipeline.run_pipeline(_rows(spark, 300))
    assert seen == [(name, len(TEXTS)) for name in ("clean", "score", "extract_features")]
    assert batch.reviews.count() == 600
    assert len(set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before) == 1  # the reviews; tables on the way are gone


def test_rows_get_what_the_operators_give_them(spark):
    rows = _rows(spark, 300)
    cleaned = language.translate(language.detect(clean.clean(rows.withColumn("ingestion_id", F.lit(7).cast("long")))))
    marked = dedup.deduplicate(cleaned.withColumn("analysed_text", F.col("cleaned_text")), "seq", "analysed_text")
    want = sentiment.analyze(fake.score_batch(marked, "analysed_text"), "seq", "analysed_text").withColumn("signal_details", F.to_json("signal_details"))
    got = pipeline.run_pipeline(rows, 7).reviews.withColumn("signal_details", F.to_json("signal_details"))
    assert dict(got.dtypes) == dict(want.dtypes)
    assert {r.seq: r for r in got.select(want.columns).collect()} == {r.seq: r for r in want.collect()}
