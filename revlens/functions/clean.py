"""Cleaning of review texts (TXT1 to TXT18) as one chain of projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions import lexicons as lx
from revlens.functions.text import SPACE, compact, literal_array, literal_map, nfkc, strip, words

HTML = r"<[^>]+>"
_SOLID = SPACE.replace("[", "[^", 1)
URL = rf"https?://{_SOLID}+|www\.{_SOLID}+"
EMAIL = rf"{_SOLID}+@{_SOLID}+\.{_SOLID}+"
EMOJI = (
    r"[\x{24C2}-\x{1F251}\x{10000}-\x{10FFFF}\x{2600}-\x{2B55}\x{2702}-\x{27B0}\x{200D}\x{23CF}\x{23E9}\x{231A}\x{FE0F}\x{3030}]"
)
EMOJI_SPAM = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{1F926}-\x{1F937}]"
REPEATED_CHARACTER = r"([^\n])\1{3,}"
REPEATED_WORD = r"(?iuU)\b(\w+)(\s+\1){2,}\b"
PUNCTUATION = r"([!?.]){3,}"
CONJUNCTION = r"(?iuU)\b(but|however|although|also|and then|then|moreover|furthermore)\b"
RUN_ON = 200


def replace_html(c: Column) -> Column:
    return F.regexp_replace(c, HTML, " ")


def replace_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL, "[URL]")


def replace_emails(c: Column) -> Column:
    return F.regexp_replace(c, EMAIL, "[EMAIL]")


def extract_emoji(c: Column) -> Column:
    """array<struct<emoji, meaning>> of the known single code points, in order."""
    known = literal_map({k: v for k, v in lx.EMOJI.items() if len(k) == 1})
    found = F.transform(F.regexp_extract_all(c, F.lit(EMOJI), F.lit(0)), lambda e: F.struct(e.alias("emoji"), F.element_at(known, e).alias("meaning")))
    return F.filter(found, lambda x: x["meaning"].isNotNull())


def purge_emoji(c: Column) -> Column:
    return F.regexp_replace(c, f"{EMOJI}+", " ")


def expand_slang(c: Column) -> Column:
    slang = literal_map(lx.SLANG)
    return F.array_join(F.transform(words(c), lambda w: F.coalesce(F.element_at(slang, F.lower(w)), w)), " ")


def fix_repeated_characters(c: Column) -> Column:
    return F.regexp_replace(c, REPEATED_CHARACTER, "$1$1")


def fix_repeated_words(c: Column) -> Column:
    return F.regexp_replace(c, REPEATED_WORD, "$1")


def fix_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, PUNCTUATION, "$1.")


def plain_quotes(c: Column) -> Column:
    return F.translate(c, "‘’“”–—", "''\"\"--")


def collapse_space(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def _count(c: Column, character: str) -> Column:
    return F.length(c) - F.length(F.translate(c, character, ""))


def is_run_on(c: Column) -> Column:
    return (F.length(c) > RUN_ON) & (_count(c, ".") < 2) & (_count(c, "!") < 2)


def split_run_on(c: Column) -> Column:
    return F.when(is_run_on(c), F.regexp_replace(c, CONJUNCTION, ". $1")).otherwise(c)


#: Step, note that it leaves, function; the note is left where the text changes, lower-cased for slang.
STEPS = (
    ("html_stripped", replace_html),
    ("urls_removed", replace_urls),
    ("emails_removed", replace_emails),
    ("emojis_purged", purge_emoji),
    ("slang_expanded", expand_slang),
    ("repeated_chars_fixed", fix_repeated_characters),
    ("repeated_words_fixed", fix_repeated_words),
    ("excessive_punctuation_normalized", fix_punctuation),
)


def clean(df: DataFrame, text: str = "original_text") -> DataFrame:
    """Adds cleaned_text, preprocessing_notes, emoji_extracted, char_count_original, char_count_cleaned.

    A null or blank text gives an empty cleaned text, the note empty_input and counts of 0.
    """
    blank = F.coalesce(strip(F.col(text)) == "", F.lit(True))
    notes: list[Column] = []
    out = df.withColumn("_t", nfkc(F.when(~blank, F.col(text)).otherwise(F.lit(""))))
    for i, (note, step) in enumerate(STEPS):
        if note == "emojis_purged":
            out = out.withColumn("_emoji", extract_emoji(F.col("_t")))
        before, after = F.col("_t"), F.col(f"_n{i}")
        out = out.withColumn(f"_n{i}", step(before))
        changed = F.lower(after) != F.lower(before) if note == "slang_expanded" else after != before
        if note == "emojis_purged":
            changed = before.rlike(EMOJI)
        out = out.withColumn(f"_c{i}", changed).withColumn("_t", after).drop(f"_n{i}")
        notes.append(F.when(F.col(f"_c{i}"), F.lit(note)))
    out = out.withColumn("_t", collapse_space(plain_quotes(F.col("_t"))))
    out = out.withColumn("_run_on", is_run_on(F.col("_t"))).withColumn("_t", split_run_on(F.col("_t")))
    notes += [F.when(F.col("_run_on"), F.lit("run_on_sentence_split")), F.when(F.size(words("_t")) <= 2, F.lit("incomplete_sentence"))]
    return out.withColumns(
        {
            "cleaned_text": F.col("_t"),
            "preprocessing_notes": F.when(blank, F.array(F.lit("empty_input"))).otherwise(compact(*notes)),
            "emoji_extracted": F.col("_emoji"),
            "char_count_original": F.when(blank, F.lit(0)).otherwise(F.length(text)),
            "char_count_cleaned": F.length("_t"),
        }
    ).drop("_t", "_emoji", "_run_on", *[f"_c{i}" for i in range(len(STEPS))])


def is_mostly_caps(c: Column, threshold: float = 0.7) -> Column:
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.when(letters >= 5, F.regexp_count(c, F.lit(r"\p{Lu}")) / letters >= threshold).otherwise(False)


def repetition_score(c: Column) -> Column:
    w = words(F.lower(c))
    return F.when(F.size(w) < 3, 0.0).otherwise(1 - F.size(F.array_distinct(w)) / F.size(w))


def matching_templates(c: Column) -> Column:
    return F.filter(literal_array(lx.CLEANER_TEMPLATES), lambda p: F.contains(F.lower(c), p))


def excessive_punctuation(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[!?]{3,}"))


def has_emoji_spam(c: Column, threshold: int = 5) -> Column:
    return F.regexp_count(c, F.lit(EMOJI)) >= threshold
