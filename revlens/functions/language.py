"""Language detection by dialect markers and scripts, with hooks for a statistical detector and a translator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions import lexicons as lx
from revlens.functions.text import SPACE, literal_array, literal_map, strip, words

#: Confidence that a detection needs before a text is translated.
TRANSLATE_ABOVE = 0.4


def detectable(c: Column) -> Column:
    """The text without URLs, digits and bracketed parts, in lower case."""
    solid = SPACE.replace("[", "[^", 1)
    without = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, rf"https?://{solid}+", ""), "[0-9]+", ""), r"\[.*?\]", "")
    return F.lower(strip(without))


def dialect(clean: Column) -> Column:
    w = words(clean)
    return F.when(F.arrays_overlap(w, literal_array(lx.HINGLISH)), "hinglish").when(F.arrays_overlap(w, literal_array(lx.KANGLISH)), "kanglish")


def script(clean: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for code, pattern in lx.SCRIPTS:
        out = out.when(clean.rlike(pattern), F.lit(code))
    return out.otherwise(F.lit("en"))


def language_name(code: Column) -> Column:
    names = literal_map(lx.LANGUAGES | {"hinglish": "Hinglish", "kanglish": "Kanglish", "unknown": "Unknown", "zh": "Chinese"})
    return F.coalesce(F.element_at(names, code), F.upper(code))


def detect(df: DataFrame, text: str = "cleaned_text", detector: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds detected_language, language_name, language_confidence.

    `detector` maps a text column to a struct<code, confidence> and stands in for the script rules.
    """
    out = df.withColumn("_d", detectable(F.coalesce(F.col(text), F.lit(""))))
    blank = F.coalesce(strip(F.col(text)) == "", F.lit(True))
    d, dial = F.col("_d"), dialect(F.col("_d"))
    found = detector(d) if detector else F.struct(script(d).alias("code"), F.when(script(d) == "en", 0.5).otherwise(0.7).alias("confidence"))
    code = F.when(blank, "unknown").when(F.length(d) < 3, "en").when(dial.isNotNull(), dial).otherwise(found["code"])
    sure = F.when(blank, 0.0).when(F.length(d) < 3, 0.5).when(dial.isNotNull(), 0.8).otherwise(found["confidence"])
    out = out.withColumns({"detected_language": code, "language_confidence": sure}).drop("_d")
    return out.withColumn("language_name", language_name(F.col("detected_language")))


def translate(df: DataFrame, text: str = "cleaned_text", translator: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Adds translated_text: null unless `translator` (text, language) changed a text that is surely not English."""
    if translator is None:
        return df.withColumn("translated_text", F.lit(None).cast("string"))
    due = (F.col("detected_language") != "en") & (F.col("language_confidence") > TRANSLATE_ABOVE) & (F.col(text) != "")
    new = translator(F.col(text), F.col("detected_language"))
    return df.withColumn("translated_text", F.when(due & (new != F.col(text)), new))
