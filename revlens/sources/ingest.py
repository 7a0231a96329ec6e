"""Reviews from CSV, JSON, pasted text or DataFrames, brought to the canonical input columns (schemas.INPUT)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens import schemas
from revlens.functions.text import literal_array, strip

# Header and key names in the order in which they are tried; they are case-sensitive.
CSV_TEXT = "review text content comment feedback review_text review_body body message description Review Text".split()
CSV_RATING = "rating score stars Rating Score Stars star_rating review_rating".split()
JSON_LISTS = "reviews data items results feedback".split()
JSON_TEXT = "review text content comment feedback review_text body message".split()
JSON_RATING = "rating score stars".split()
ALIASES = {
    "original_text": ("review", "text", "content", "original_text"),
    "rating": ("rating", "score", "stars"),
    "product_category": ("product_category", "product", "category"),
    "review_date": ("date", "review_date"),
    "original_review_id": ("id",),
    "user_id": ("user_id",),
}
DEFAULTS = {"original_text": "", "product_category": "General", "original_review_id": "", "user_id": ""}
#: Characters that a value needs to be taken for the text where no header names one.
LONG_VALUE = 10


def number(c: Column) -> Column:
    """A finite number, or null: what Java alone would parse (4d) is no number here."""
    plain = c.rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$")
    value = F.when(plain, F.trim(c).try_cast("double"))
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _numbered(df: DataFrame) -> DataFrame:
    """seq in the order of the source; ids are unique and ascending, not dense."""
    return df.withColumn("seq", F.monotonically_increasing_id())


def from_csv_frame(df: DataFrame, keep_columns: bool = False) -> DataFrame:
    """Rows of a header-bearing CSV, all columns strings. Of date, user, id and category nothing is kept by default."""
    columns = [c for c in df.columns if c != "_rescued"]
    filled = lambda c: F.when(_quoted(c) != "", _quoted(c))
    named = [filled(c) for c in CSV_TEXT if c in columns]
    values = F.array(*[_quoted(c) for c in columns]) if columns else F.array().cast("array<string>")
    long_value = F.get(F.filter(values, lambda v: F.length(v) > LONG_VALUE), 0)
    text = F.coalesce(*named, long_value)
    ratings = [filled(c) for c in CSV_RATING if c in columns]
    rating = number(F.coalesce(*ratings)) if ratings else F.lit(None).cast("double")  # the first that is there decides
    extra = {k: F.coalesce(*[filled(c) for c in v if c in columns]) if any(c in columns for c in v) else F.lit(None) for k, v in ALIASES.items() if k not in ("original_text", "rating")} if keep_columns else {}
    out = df.select(text.alias("original_text"), rating.alias("rating"), *[v.cast("string").alias(k) for k, v in extra.items()]).where("original_text is not null")
    return canonical(_numbered(out), "csv_upload")


def read_csv(spark: SparkSession, path: str, keep_columns: bool = False) -> DataFrame:
    """A CSV file or folder: UTF-8 with or without a byte order mark, quoted newlines, doubled quotes."""
    spark.conf.set("spark.sql.caseSensitive", "true")  # headers differ by case alone
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    return from_csv_frame(raw.toDF(*[c.lstrip("﻿") for c in raw.columns]), keep_columns)


def _items(documents: DataFrame, column: str) -> DataFrame:
    """One row `j` (JSON text) for each review in each JSON document; malformed documents and scalars give none."""
    doc = documents.select(F.try_parse_json(F.col(column)).alias("v"), F.col(column).alias("raw")).where("v is not null")
    kind = F.schema_of_variant("v")
    lists = [F.when(F.try_variant_get("v", f"$.{k}", "array<variant>").isNotNull(), F.try_variant_get("v", f"$.{k}", "array<variant>")) for k in JSON_LISTS]
    one = F.when(F.startswith(kind, F.lit("OBJECT")), F.array(F.col("v")))
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), *lists, one)
    return doc.select(F.explode(items).alias("item")).select(F.to_json("item").alias("j"), F.schema_of_variant("item").alias("kind"), F.try_variant_get("item", "$", "string").alias("whole"))


def _key(keys: tuple[str, ...] | list[str], truthy: bool = False) -> Column:
    """The value of the first key that is there, null values included; with `truthy`, the first that isn't empty."""
    have = F.coalesce(F.json_object_keys("j"), F.array().cast("array<string>"))
    out = F.when(F.lit(False), F.lit(""))
    for k in keys:
        value = F.get_json_object("j", f"$.{k}")
        there = F.array_contains(have, F.lit(k))
        out = out.when(there & (value != "") & ~value.isin("0", "false", "[]", "{}") if truthy else there, value)
    return out


def from_json_items(items: DataFrame, source: str = "json_upload") -> DataFrame:
    """JSON items (`j`, `kind`, `whole`): strings, or objects whose own source stays."""
    is_text = F.col("kind") == "STRING"
    out = items.where(is_text | F.startswith("kind", F.lit("OBJECT"))).select(
        F.when(is_text, F.col("whole")).otherwise(_key(JSON_TEXT, truthy=True)).alias("original_text"),
        F.when(~is_text, number(_key(JSON_RATING))).alias("rating"),
        *[F.when(~is_text, _key(ALIASES[k])).alias(k) for k in ("product_category", "review_date", "original_review_id", "user_id")],
        F.coalesce(F.when(~is_text, F.get_json_object("j", "$.source")), F.lit(source)).alias("source"),
    )
    return canonical(_numbered(out.where("original_text is not null and original_text <> ''")), source)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return from_json_items(_items(spark.read.text(path, wholetext=True), "value"))


def from_paste(spark: SparkSession, text: str, source: str = "manual_paste") -> DataFrame:
    """JSON if the text is bracketed and parses to reviews, otherwise a review for each line that isn't blank."""
    body = text.strip()
    rows = spark.createDataFrame([(body,)], "value string")
    if body[:1] + body[-1:] in ("[]", "{}"):
        found = from_json_items(_items(rows, "value"))
        if found.take(1):
            return found
    return from_lines(rows, source=source)


def from_lines(df: DataFrame, column: str = "value", source: str = "manual_paste") -> DataFrame:
    lines = df.select(F.posexplode(F.split(column, "\n")).alias("seq", "line")).select(F.col("seq").cast("long"), strip("line").alias("original_text"))
    return canonical(lines.where("original_text <> ''"), source)


def from_records(df: DataFrame, json_column: str, source: str = "upload") -> DataFrame:
    """Records as JSON texts: each alias is looked up by presence, so a null under the first key hides later ones."""
    items = df.select(F.col(json_column).alias("j"))
    out = items.select(
        *[F.coalesce(number(_key(v)) if k == "rating" else _key(v), F.lit(DEFAULTS[k]) if k in DEFAULTS and k != "original_text" else F.lit(None)).alias(k) if k != "original_text"
          else F.when(F.arrays_overlap(F.coalesce(F.json_object_keys("j"), F.array().cast("array<string>")), literal_array(v)), _key(v)).otherwise("").alias(k)
          for k, v in ALIASES.items()],
        F.coalesce(F.get_json_object("j", "$.source"), F.lit(source)).alias("source"),
    )
    return canonical(_numbered(out), source)


def from_frame(df: DataFrame, source: str = "api_feed") -> DataFrame:
    """A DataFrame with any of the alias columns."""
    pick = lambda names: next((_quoted(n) for n in names if n in df.columns), F.lit(None))
    out = df.select(
        *[(number(pick(v).cast("string")) if k == "rating" else F.coalesce(pick(v).cast("string"), F.lit(DEFAULTS.get(k)))).alias(k) for k, v in ALIASES.items()],
        F.coalesce(pick(("source",)).cast("string"), F.lit(source)).alias("source"), *([F.col("seq")] if "seq" in df.columns else []),
    )
    return canonical(out if "seq" in df.columns else _numbered(out), source)


def canonical(df: DataFrame, source: str) -> DataFrame:
    """The columns of schemas.INPUT; what is missing is null, or its default."""
    fill: dict[str, Callable[[], Column]] = {"source": lambda: F.lit(source), "product_category": lambda: F.lit("General")}
    out = []
    for f in schemas.INPUT:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        c = F.coalesce(c.cast(f.dataType), fill[f.name]()) if f.name in fill else c.cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def synthetic(spark: SparkSession, today: str) -> DataFrame:
    """215 reviews (SRC8) with a battery defect in the newest 14 days of the smartwatch; the draw is a hash of the row."""
    groups = ((80, "Smartphone", 60), (60, "Headphones", 60), (40, "Smartwatch", 60), (35, "Smartwatch", 14))
    good = ("Great camera and a fast processor, love it.", "The display is excellent and the battery is good.", "Sound quality is amazing for the price.", "Delivery was fast, very happy with it.")
    bad = ("Terrible battery, it drains in two hours.", "The battery is horrible since the update.", "Battery died again, the worst watch.")
    n, ends = F.col("id"), []
    total = 0
    for size, *_ in groups:
        total += size
        ends.append(total)
    pick = lambda values: F.element_at(literal_array(values), (F.pmod(F.xxhash64("id"), F.lit(len(values))) + 1).cast("int"))
    category, span = F.lit(groups[-1][1]), F.lit(groups[-1][2])
    for end, (_, name, days) in reversed(list(zip(ends[:-1], groups[:-1], strict=True))):
        category, span = F.when(n < end, name).otherwise(category), F.when(n < end, days).otherwise(span)
    defect = n >= ends[-2]
    day = F.date_sub(F.lit(today).cast("date"), F.pmod(F.xxhash64("id", F.lit(1)), span).cast("int"))
    return spark.range(total).select(
        n.alias("seq"), F.when(defect, pick(bad)).otherwise(pick(good)).alias("text"), F.when(defect, 1).otherwise(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(3)) + 3).cast("double").alias("rating"),
        category.alias("product_category"), day.cast("string").alias("date"), F.lit("synthetic").alias("source"),
    )
