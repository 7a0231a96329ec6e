"""Personal data: pattern spans, and terms whose co-occurrence with them discloses them. DataFrame functions only.

Base spans are the leftmost non-overlapping matches of four patterns, checked by digits, ranges and Luhn sums.
Information-theoretic step: the protected entities are the distinct base values. For each entity e and each term t
within CONTEXT code points of it, the corpus gives PMI(t; e) = log2(N c(t,e) / (df(t) df(e))), with documents
counted over the whole corpus. The share PMI(t; e) / IC(e), IC(e) = log2(N / df(e)), says how much of what there is
to know of e the term tells. Terms with a share of at least DISCLOSURE, seen with e in at least SUPPORT different
contexts (copies of a passage are one context), are spans of kind `term` in e's documents, and are generalised there.

Work and memory are in proportion to a text's length, however many spans it has: a match carries the text beside it
from the same pass that found it, and texts are cut in pieces of PIECE code points before they are cut at spans.

Defined results: a null text is an empty one and has no spans; very long texts are read whole; of overlapping spans the
one that begins first (then the longer, then the kind listed first) is replaced whole and of the others what it leaves;
terms of equal share are all taken; repeated rows get a result each and count as documents each; rows with null doc_id
are kept, and ids of any type; an empty table gives an empty result; other columns, whatever their names, are ignored by
`find` and kept by `sanitise`, which takes two rows for the same if their ids and two 64-bit hashes of their texts agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlens.llm.common import table, text_or_empty, written
from revlens.llm.url_filter import _block, _mask, blocks_for, bloom_filter

#: kind, pattern, what a text must contain. Possessive quantifiers keep Java's matcher iterative and linear; none of
#: them changes a match. A match starts where its first run of characters starts, or where the last match ended.
PATTERNS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", None),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)
KINDS = tuple(k for k, _, _ in PATTERNS)
#: Code points on either side of an entity that tell its contexts apart.
CONTEXT = 64
#: Least share of an entity's information that a disclosing term tells.
DISCLOSURE = 0.8
#: Least number of different contexts that have term and entity together.
SUPPORT = 2
#: Least letters of a term.
TERM_LETTERS = 3
#: Code points of the pieces in which a text is cut at its spans.
PIECE = 1024
#: Matches that the context of a match can touch on either side: each has 5 code points or more.
_BESIDE = (CONTEXT + 1) // 5
_TERM = r"[\p{L}\p{N}]++"


def _valid(kind: Column, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    part = F.transform(F.split(m, r"\."), lambda x: F.regexp_replace(x, "^0+", ""))
    ip = F.forall(part, lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255")))

    def luhn(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    card = F.when(n.between(13, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), luhn) % 10 == 0).otherwise(False)
    return F.when(kind == "email", True).when(kind == "ip", ip).when(kind == "card", card).otherwise(n.between(9, 15))


def _two_hashes(t: Column) -> Column:
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(t, F.lit(11)).alias("b"))


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written once: rid, doc_id, th (hashes of the text), the raw matches of each kind with the gap before them and what
    is beside them in the gaps, text where there are any."""
    t, near = F.col("t"), F.lit(CONTEXT + 1)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"))
    found = rows.select(
        "*",
        _two_hashes(t).alias("th"),
        *[
            F.when(F.contains(t, F.lit(has)) if has else t.rlike("[0-9]"), F.regexp_extract_all(t, F.lit(p), F.lit(0))).alias(f"m_{k}")
            for k, p, has in PATTERNS
        ],
    )
    some = {k: F.coalesce(F.size(f"m_{k}"), F.lit(0)) > 0 for k in KINDS}
    end = lambda x: F.substring(x, -F.least(near, F.length(x)), near)
    cut = [F.when(some[k], F.transform(F.split(t, p, -1), lambda g: F.struct(F.length(g).alias("n"), end(g).alias("before"), F.left(g, near).alias("after")))).alias(f"g_{k}") for k, p, _ in PATTERNS]
    any_ = some["email"] | some["ip"] | some["card"] | some["phone"]
    cols = ["rid", "doc_id", "th", *[f"m_{k}" for k in KINDS]]

    def beside(k: str) -> Column:
        gap = lambda i: F.get(f"g_{k}", i)
        return F.transform(f"m_{k}", lambda m, i: F.struct(m.alias("m"), gap(i)["n"].alias("gap"), gap(i)["before"].alias("before"), gap(i + 1)["after"].alias("after"))).alias(k)

    return written(found.select(*cols, *cut, F.when(any_, t).alias("t")).select("rid", "doc_id", "th", *[beside(k) for k in KINDS], "t", F.length("t").alias("n")))


def base_spans(found: DataFrame) -> DataFrame:
    """Written: rid, ord, kind, start, end, value, l, r, n: one row for each base span with the text beside it and the
    text's length; ends are exclusive."""
    none = F.array().cast("array<struct<m:string,gap:int,before:string,after:string>>")

    def numbered(o: int, kind: str) -> Column:
        return F.transform(F.coalesce(F.col(kind), none), lambda x, i: F.struct(F.lit(o).alias("ord"), F.lit(kind).alias("kind"), i.alias("i"), x.alias("x")))

    each = F.concat(*[numbered(o, kind) for o, kind in enumerate(KINDS)])
    order = Window.partitionBy("rid", "ord").orderBy("i")
    near = F.lit(CONTEXT + 1)
    m, before, after = F.col("m"), F.col("before"), F.col("after")
    # what stands left of a match: its gap, the match before, the gap before that and so on, until enough
    left = F.concat(F.array_join(F.collect_list(F.concat(before, F.substring(m, -F.least(near, F.length(m)), near))).over(order.rowsBetween(-_BESIDE, -1)), ""), before)
    right = F.concat(after, F.array_join(F.collect_list(F.concat(F.left(m, near), after)).over(order.rowsBetween(1, _BESIDE)), ""))
    rows = (
        found.where("t is not null")
        .select("rid", "n", F.explode(each).alias("e"))
        .select("rid", "n", "e.ord", "e.kind", "e.i", "e.x.*")
        .repartition("rid")
        .withColumn("end", F.sum(F.col("gap").cast("long") + F.length("m")).over(order))
        .withColumns({"l": left, "r": right})
        .where(_valid(F.col("kind"), m))
    )
    start = F.col("end") - F.length("m")
    return written(
        rows.select("rid", "ord", "kind", start.alias("start"), "end", F.lower("m").alias("value"), F.substring("l", -F.least(near, F.length("l")), near).alias("l"), F.left("r", near).alias("r"), "n")
    )


def _terms(side: Column, first: Column, whole_left: Column, whole_right: Column) -> Column:
    """array<struct<w, start, end>> of a window that starts at `first`; a term cut by the window's edge is left out."""
    words, gaps = F.regexp_extract_all(side, F.lit(_TERM), F.lit(0)), F.split(side, _TERM, -1)

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["w"])
        inside = (whole_left | (start > 0)) & (whole_right | (end < F.length(side))) & (F.length(x["w"]) >= TERM_LETTERS)
        term = F.struct(F.lower(x["w"]).alias("w"), (first + start).alias("start"), (first + end).alias("end"))
        return F.struct(end.alias("at"), F.when(inside, F.concat(acc["out"], F.array(term))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast("array<struct<w:string,start:bigint,end:bigint>>")
    zipped = F.filter(F.arrays_zip(words.alias("w"), gaps.alias("g")), lambda x: x["w"].isNotNull())
    # a window has at most CONTEXT + 1 code points, so the accumulated array stays short
    return F.aggregate(zipped, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), add, lambda a: a["out"])


def surroundings(spans: DataFrame) -> DataFrame:
    """rid, entity, ctx (hash of the surrounding text), l, r, lf, end, at_end: the text near each base span."""
    return spans.select(
        "rid", F.concat_ws(":", "kind", "value").alias("entity"), F.xxhash64("l", "r").alias("ctx"), "l", "r",
        F.greatest(F.lit(0).cast("long"), F.col("start") - CONTEXT - 1).alias("lf"), "end", (F.col("end") + CONTEXT + 1 >= F.col("n")).alias("at_end"),
    )


def contexts(near: DataFrame) -> DataFrame:
    """rid, entity, ctx, w: the terms of the surroundings."""
    terms = F.concat(
        _terms(F.col("l"), F.col("lf"), F.col("lf") == 0, F.lit(False)),
        _terms(F.col("r"), F.col("end"), F.lit(False), F.col("at_end")),
    )
    return near.select("rid", "entity", "ctx", F.explode(terms).alias("x")).select("rid", "entity", "ctx", "x.w")


def replaced(texts: DataFrame, spans: DataFrame, by: Column) -> DataFrame:
    """rid, clean: the texts (rid, t) that have spans, with each span (rid, ord, kind, start, end) replaced by `by`."""
    before = Window.partitionBy("rid").orderBy("start", F.desc("end"), "ord").rowsBetween(Window.unboundedPreceding, -1)
    piece = F.lit(PIECE)
    # of what begins inside an earlier span the rest; then the parts of each cut by piece
    cuts = (
        spans.repartition("rid").withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(0)))
        .where(F.col("end") > F.col("reach"))
        .select("rid", F.greatest("start", "reach").alias("start"), "end", by.alias("by"))
        .select("rid", "start", "end", "by", F.explode(F.sequence(F.floor(F.col("start") / piece), F.floor((F.col("end") - 1) / piece))).alias("c"))
    )
    first = F.col("c") * piece
    inside = F.struct(
        F.greatest(F.col("start") - first, F.lit(0)).cast("int").alias("from"), F.least(F.col("end") - first, piece).cast("int").alias("to"),
        F.when(F.col("start") >= first, F.col("by")).otherwise("").alias("by"),
    )
    by_piece = cuts.groupBy("rid", "c").agg(F.sort_array(F.collect_list(inside)).alias("xs"))  # PIECE at most
    with_spans = texts.join(spans.select("rid").distinct(), "rid", "left_semi").select("rid", F.posexplode(F.regexp_extract_all("t", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("at", "s"))
    s, xs = F.col("s"), F.col("xs")
    last = lambda i: F.when(i > 0, F.get(xs, i - 1)["to"]).otherwise(0)
    parts = F.transform(xs, lambda x, i: F.concat(F.substring(s, last(i) + 1, x["from"] - last(i)), x["by"]))
    new = F.when(xs.isNull(), s).otherwise(F.concat(F.array_join(parts, ""), F.substring(s, F.element_at(xs, -1)["to"] + 1, piece)))
    both = with_spans.withColumn("at", F.col("at").cast("long")).repartition("rid").join(by_piece.withColumnRenamed("c", "at").hint("shuffle_hash"), ["rid", "at"], "left")
    return both.groupBy("rid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", new.alias("s")))), lambda x: x["s"]), "").alias("clean"))


def together(found: DataFrame, near: DataFrame, spans: DataFrame, entities: DataFrame) -> DataFrame:
    """entity, w, support, c: the terms of an entity's documents outside base spans; only entities of several documents."""
    several = entities.where(F.col("df_e") > 1).select("entity")
    held = near.join(several, "entity").groupBy("rid", "entity").agg(F.min("ctx").alias("ctx"))
    held = written(held)
    rest = (
        replaced(found.select("rid", "t").where("t is not null"), spans.join(held.select("rid").distinct(), "rid", "left_semi"), F.lit("\n"))
        .select("rid", F.regexp_extract_all("clean", F.lit(_TERM), F.lit(0)).alias("ws"))
    )
    ws = F.col("ws")
    # terms beside a term tell copies of its passage apart from other passages
    beside = F.transform(ws, lambda w, i: F.struct(F.lower(w).alias("w"), F.xxhash64(F.get(ws, i - 1), F.get(ws, i + 1)).alias("beside")))
    words = rest.select("rid", F.explode(F.filter(beside, lambda x: F.length(x["w"]) >= TERM_LETTERS)).alias("x")).select("rid", "x.*")
    once = words.groupBy("rid", "w").agg(F.min("beside").alias("beside"))
    both = once.join(held, "rid").groupBy("entity", "w", F.xxhash64("ctx", "beside").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return both.groupBy("entity", "w").agg(F.count(F.lit(1)).alias("support"), F.sum("n").alias("c"))


def disclosing(docs: DataFrame, found: DataFrame, near: DataFrame, spans: DataFrame, text_col: str = "text") -> DataFrame:
    """entity, w, share: the terms that tell at least DISCLOSURE of an entity, over the corpus `docs`."""
    entities = spans.select(F.concat_ws(":", "kind", "value").alias("entity"), "rid").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("df_e"))
    entities = written(entities)
    beside = (
        contexts(near).distinct()
        .groupBy("entity", "w")
        .agg(F.count_distinct("ctx").alias("support"), F.count_distinct("rid").alias("c"))
        .where(F.col("support") >= SUPPORT)
    )
    # a term near e is in e's document too, so the greater count is that of the documents
    pairs = (
        beside.unionByName(together(found, near, spans, entities))
        .groupBy("entity", "w").agg(F.max("support").alias("support"), F.max("c").alias("c"))
        .where(F.col("support") >= SUPPORT)
    )
    pairs = written(pairs)
    listed = pairs.select(F.col("w").alias("rule_host"), F.lit("").alias("rule_path")).distinct()
    blocks = blocks_for(listed.count())
    bloom = bloom_filter(listed, blocks).select("bloom")
    possible = lambda w: F.get("bloom", _block(w, blocks)).bitwiseAND(_mask(w)) == _mask(w)
    df_t = (
        docs.select(text_or_empty(text_col).alias("t"))
        .crossJoin(F.broadcast(bloom))  # one row of 8 MB at most
        .select(F.explode(F.array_distinct(F.filter(F.split(F.lower("t"), r"[^\p{L}\p{N}]+"), possible))).alias("w"))
        .groupBy("w")
        .agg(F.count(F.lit(1)).alias("df_t"))
    )
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    ic = F.log2(F.col("n") / F.col("df_e"))
    pmi = F.log2(F.col("n") * F.col("c") / (F.col("df_t") * F.col("df_e")))
    return (
        pairs.join(entities, "entity").join(df_t, "w").crossJoin(F.broadcast(total))  # one row
        .withColumn("share", F.when(ic > 0, pmi / ic).otherwise(0.0))
        .where(F.col("share") >= DISCLOSURE)
        .select("entity", "w", "share")
    )


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(found, spans): the written rows, and the spans of all kinds: rid, ord, kind, start, end."""
    found = matches(docs, id_col, text_col)
    base = base_spans(found)
    near = surroundings(base)
    told = disclosing(docs, found, near, base, text_col)
    listed = near.select("rid", "entity").distinct().join(told, "entity").select("rid", "w").distinct()
    return found, outside_base(base.select("rid", "ord", "kind", "start", "end"), occurrences(found, written(listed)))


def occurrences(found: DataFrame, listed: DataFrame) -> DataFrame:
    """rid, ord, kind, start, end: every occurrence of the listed terms (rid, w) in the whole texts of their documents."""
    t = F.col("t")
    zipped = F.arrays_zip(F.regexp_extract_all(t, F.lit(_TERM), F.lit(0)).alias("w"), F.transform(F.split(t, _TERM, -1), lambda x: F.length(x)).alias("gap"))
    before = Window.partitionBy("rid").orderBy("i")
    words = (
        found.select("rid", "t").join(listed.select("rid").distinct(), "rid", "left_semi")
        .select("rid", F.posexplode(zipped).alias("i", "x")).where("x.w is not null")
        .select("rid", "i", F.lower("x.w").alias("w"), F.length("x.w").alias("n"), F.col("x.gap").alias("gap"))
        .repartition("rid")
        .withColumn("end", F.sum((F.col("gap") + F.col("n")).cast("long")).over(before))
    )
    return words.join(listed, ["rid", "w"], "left_semi").select(
        "rid", F.lit(len(KINDS)).alias("ord"), F.lit("term").alias("kind"), (F.col("end") - F.col("n")).alias("start"), "end"
    )


def outside_base(base: DataFrame, terms: DataFrame) -> DataFrame:
    """The base spans, and the terms that overlap none of them: what a base span covers is protected already.

    In order of (start of a base span, end of a term), a term overlaps a base span if one before it ends beyond the
    term's start; so one pass over a document's spans tells, however many there are.
    """
    is_base = F.col("ord") < len(KINDS)
    before = Window.partitionBy("rid").orderBy(F.when(is_base, F.col("start")).otherwise(F.col("end")), is_base).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.coalesce(F.max(F.when(is_base, F.col("end"))).over(before), F.lit(0))
    return base.unionByName(terms).withColumn("reach", reach).where(is_base | (F.col("start") >= F.col("reach"))).drop("reach")


def report(found: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per document: counts by kind, the hash of the base spans, all spans."""
    text = F.concat_ws(":", "kind", "start", "end")
    listed = lambda c: F.array_join(F.transform(F.sort_array(c), lambda x: x["s"]), ",")
    item = F.struct("ord", "start", "end", text.alias("s"))
    by = spans.groupBy("rid").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in (*KINDS, "term")],
        F.collect_list(F.when(F.col("kind") != "term", item)).alias("base"),
        F.collect_list(item).alias("all"),
    )
    out = by.select("rid", *[f"n_{k}" for k in (*KINDS, "term")], listed(F.col("base")).alias("b"), listed(F.col("all")).alias("spans"))
    return found.select("rid", "doc_id").join(out, "rid", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("b", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_term", F.lit(0)).cast("long").alias("n_term"),
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with every span replaced by its kind, as [EMAIL]; all other columns and all rows stay."""
    found, spans = find(docs, id_col, text_col)
    clean = replaced(found.select("rid", "t").where("t is not null"), spans, F.concat(F.lit("["), F.upper("kind"), F.lit("]")))
    # rows equal in id and text are changed alike
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    changed = found.select("rid", key("doc_id").alias("_k"), F.col("doc_id").isNull().alias("_none"), F.col("th").alias("_th")).join(clean, "rid").groupBy("_k", "_none", "_th").agg(F.min("clean").alias("_clean"))
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # names of the input can't clash with ours
    keyed = docs.select(packed, key(id_col).alias("key"), F.col(id_col).isNull().alias("none"), _two_hashes(text_or_empty(text_col)).alias("h"))
    same = (F.col("key") == F.col("_k")) & (F.col("none") == F.col("_none")) & (F.col("h") == F.col("_th"))
    return keyed.join(changed.hint("shuffle_hash"), same, "left").select(
        *[(F.coalesce("_clean", f"row.`{c}`") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, spans = find(table(spark, sf_dir, "documents"))
    return report(found, spans)
