"""Corpus operators against brute force, SQL and edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import canonical

pytest.importorskip("revlens.llm")
from revlens.llm import bpe, licenses, packing, pii, quality_rules, registry, simhash, suffix_dedup, top_k, toxicity, url_filter  # noqa: E402
from revlens.operators.components import components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row string"
EDGE = [(1, "plain words here", "en", "a", 3, "x", "y"), (1, "plain words here", "en", "a", 3, "x", "y"), (None, None, None, None, None, None, None), (2, "", "de", "b", 0, "x", "y"), (3, "w " * 30000, "en", "a", 1, "x", "y")]


def frame(spark, rows):
    """Rows with further columns that are named like the operators' own."""
    from pyspark.sql import functions as F

    own = "_key _h _k _th _clean predicted evidence fp component_id id k th t kept spans rid length bucket rank host"
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in own.split()})


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    found = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(found.fetchall(), columns)


OPERATORS = {
    "licenses": licenses.scan, "pii": lambda d: pii.report(*pii.find(d)), "packing": packing.pack, "quality": quality_rules.quality_rules,
    "simhash": simhash.near_duplicates, "bpe": bpe.round_trip, "suffix": suffix_dedup.removed,
    "toxicity": lambda d: toxicity.score(d, d.sparkSession.createDataFrame([(1, 1), (2, 0), (None, None)], "doc_id long, toxic int")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
@pytest.mark.parametrize("rows", [EDGE, []], ids=["edge", "empty"])
def test_nulls_repeats_and_empty_tables(spark, name, rows):
    got = OPERATORS[name](frame(spark, rows)).collect()
    if name == "packing":
        assert len({(r.doc_id, r.piece, r.sequence_id, r.offset) for r in got}) == len(got) >= len(rows)
    else:
        assert len(got) == len(rows)


@pytest.mark.parametrize("fn", [simhash.keep_one, suffix_dedup.strip, pii.sanitise])
def test_stages_keep_columns(spark, fn):
    df = frame(spark, EDGE)
    out = fn(df)
    assert out.columns == df.columns
    assert out.count() == (3 if fn is simhash.keep_one else 5)
    assert {r._key for r in out.collect()} == {"own"} and {r.predicted for r in out.collect()} == {"own"}
    assert fn(frame(spark, [])).count() == 0


def test_clean_documents_keep_their_columns(spark):
    rows = [(i, "vile nasty words here" if i % 2 else "calm good words here", "en", "a", 3, "x", "y") for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    df = frame(spark, rows)
    out = toxicity.keep_clean(df, labels)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == list(range(0, 80, 2))
    scored = toxicity.score(df, labels).collect()
    assert all(r.predicted == r.doc_id % 2 and r.score != "x" for r in scored)


# --- personal data


def test_terms_outside_base_spans(spark):
    rng = random.Random(8)
    span = lambda: (a := rng.randrange(60), a + rng.randrange(1, 9))
    base = [(rid, rng.randrange(4), "email", *span()) for rid in range(30) for _ in range(rng.randrange(4))]
    terms = [(rid, 4, "term", *span()) for rid in range(30) for _ in range(8)]
    kind = "rid long, ord int, kind string, start long, end long"
    got = pii.outside_base(spark.createDataFrame(base, kind), spark.createDataFrame(terms, kind)).collect()
    free = [t for t in terms if not any(b[0] == t[0] and b[3] < t[4] and b[4] > t[3] for b in base)]
    assert 0 < len(free) < len(terms) and sorted(map(tuple, got)) == sorted(base + free)


def _luhn(d):
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and _luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def base_spans(t):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in KINDS for m in re.finditer(p, t or "") if ok(m.group()))


def test_pii_base_spans(spark):
    rng = random.Random(5)
    parts = ["a@b.co", "%x@y.z-q.w", "..", "1.2.3.4", ".255", "999.1.1.1", "4111 1111 1111 1111", "-5555555555554444", "+1 (988) 555-2485", "+", "é", "😀", " ", "x", "0001", "@", "a.b"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(8))) for _ in range(400)] + ["1 " * 20000, "x" * 50000 + "@"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.report(*pii.find(df)).collect():
        assert r.base_sha256 == hashlib.sha256(base_spans(texts[r.doc_id]).encode()).hexdigest(), texts[r.doc_id]


def test_pii_contexts_and_replacements_equal_slices(spark, monkeypatch):
    """Contexts come from the gaps, and texts are cut piece by piece; here by positions in the whole text."""
    rng = random.Random(9)
    parts = ["a@b.co", "1.2.3.4", "4111 1111 1111 1111", "+1 (988) 555-2485", "é", "😀", " ", "word", ", ", "x" * 70, " the quick brown fox ", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(120)] + ["a@b.co " * 700, "x" * 3000 + "@y.zz"]
    monkeypatch.setattr(pii, "PIECE", 50)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.matches(df)
    base = pii.base_spans(found)
    rows = base.join(found.select("rid", "doc_id"), "rid").collect()
    assert len(rows) > 1000
    for r in rows:
        t = texts[r.doc_id]
        assert (t[r.start : r.end].lower(), t[max(0, r.start - 65) : r.start], t[r.end : r.end + 65], len(t)) == (r.value, r.l, r.r, r.n)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    order = [*pii.KINDS, "term"]
    listed = {r.doc_id: [x.split(":") for x in r.spans.split(",") if x] for r in pii.report(*pii.find(df)).collect()}
    for i, t in enumerate(texts):
        out, at = "", 0
        for a, b, _, kind in sorted((int(a), -int(b), order.index(k), k) for k, a, b in listed[i]):
            if -b > at:
                out, at = out + t[at : max(a, at)] + f"[{kind.upper()}]", -b
        assert clean[i] == out + t[at:]


def test_pii_on_a_text_of_many_spans(spark):
    """Time in proportion to the spans of one text: 100,000 addresses."""
    text = " ".join(f"u{i % 977}@h{i % 13}.org" for i in range(100_000))
    df = spark.createDataFrame([(1, text), (2, "plain")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(*pii.find(df)).collect()}
    assert got[1].n_email == 100_000 and got[2].n_email == 0
    assert {r.doc_id: r.text.count("[EMAIL]") for r in pii.sanitise(df).collect()} == {1: 100_000, 2: 0}


def test_pii_disclosing_term(spark):
    rng = random.Random(1)
    filler = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(20))
    texts = [f"{filler()} zorblax wrote a@b.co {filler()}" for _ in range(3)] + [filler() for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.report(*pii.find(df)).collect()}
    for i in range(3):
        at = texts[i].index("zorblax")
        assert f"term:{at}:{at + 7}" in rows[i].spans
    assert all(not rows[i].spans for i in range(3, 203))
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "[TERM] " in clean[0] and "[EMAIL]" in clean[0] and clean[7] == texts[7]


def test_pii_terms_far_from_their_entity(spark):
    """A name in the heading and an e-mail in the footer count together; every occurrence goes, also far ones."""
    rng = random.Random(3)
    filler = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(60))
    texts = [f"{rng.choice(['mister', 'doctor'])} Zorblax {filler()} zorblax {filler()} write to a@b.co" for _ in range(3)]
    texts += [f"quorlin wrote c@d.co {filler()} Quorlin {filler()}", f"{filler()} quorlin sent c@d.co", f"zorblax {filler()}"]
    copied = f"only vexmoth knows e@f.co {filler()}"
    texts += [copied, copied] + [filler() for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.report(*pii.find(df)).collect()}
    for i in range(5):
        name = "zorblax" if i < 3 else "quorlin"
        want = {f"term:{m.start()}:{m.end()}" for m in re.finditer(name, texts[i].lower())}
        assert want and want <= set(rows[i].spans.split(",")), texts[i]
    # a document without the entity keeps the term, and copies are one context
    assert not rows[5].spans and rows[6].n_term == rows[7].n_term == 0
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all("orblax" not in clean[i] for i in range(3)) and clean[5] == texts[5]


# --- packing


def test_packing_is_gapless_and_tight(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    t = Tokenizer.from_file(packing.vocabulary_path())
    want = {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect()}
    by, lengths = {}, Counter()
    for r in packing.pack(docs).collect():
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        lengths[r.doc_id] += r.length
    assert lengths == want
    for slots in by.values():
        at = 0
        for offset, n in sorted(slots):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    assert len(by) <= -(-sum(want.values()) // packing.CAPACITY) + 1


def test_pieces_equal_a_direct_encoding(spark):
    """piece, start, length and crc32 of every piece, on hostile texts and on one of several sequences."""
    import zlib

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    rng = random.Random(5)
    parts = ["a", "b", "aa", "th", "in", "er", "the", "'s", "'re", "'l", "<|endoftext|>", "<|ENDOFTEXT|>", "É", "ñ", "ª", "²", "¼", "×", " ", ",", "...", "$$", "中", "😀", "é", "Σ", "ς", "İ", "\xad", "\xa0", "\x85", "\x1c", "7", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)] + [None, "", "word, " * 9000, "x" * 30000]
    got = {}
    for r in packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        cut = [ids[a : a + packing.CAPACITY] for a in range(0, len(ids), packing.CAPACITY)]
        assert sorted(got[i]) == [(n, n * packing.CAPACITY, len(x), zlib.crc32(x.tobytes())) for n, x in enumerate(cut)], texts[i]


def test_a_full_table_of_chunks_changes_no_ids():
    path = packing.vocabulary_path()
    ranks = packing.merge_ranks(path)
    small, large = packing.WordEncoder(path, ranks, 2000), packing.WordEncoder(path, ranks)
    plain = packing.WordEncoder(path, None)  # the tokenizer alone
    texts = [b"the cat, the DOG; " * 3 + bytes([97 + i % 26, 98 + i % 7]) * (1 + i % 5) for i in range(300)]
    assert list(small.encode(texts)) == list(large.encode(texts)) == list(plain.encode(texts))
    assert len(small) < 60 < len(large)


# --- BPE


def test_transducer_equals_merging():
    path, pattern = bpe.vocabulary()
    import tiktoken

    coder, ranks = bpe.ByteBpe(path, pattern), bpe.read_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    chars = "ab e'sSt \n\t  .,!?0123456789éß中😀  \x85\x1c​́-=_#<|>"
    for t in ["".join(rng.choice(chars) for _ in range(rng.randrange(25))) for _ in range(3000)] + ["a" * 3000, " " * 999, "=" * 700]:
        ids = coder.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t)
        assert "".join(coder.decode(ids)) == t


def test_texts_without_spaces_and_full_tables():
    path, pattern = bpe.vocabulary()
    small, large = bpe.ByteBpe(path, pattern, 3000), bpe.ByteBpe(path, pattern)
    texts = ["word number %d of 中文 texts" % (i % 70) for i in range(300)] + ["中文字符没有空格" * 40_000, "x" * 300_000]
    assert [small.encode(t) for t in texts] == [large.encode(t) for t in texts]
    assert max(map(len, large._known)) <= bpe.LONGEST_KEPT and len(small._known) < 20
    assert b"".join(small.decode_blocks(small.encode(texts[-2]))) == texts[-2].encode()


def test_utf8_stream_never_splits_a_character():
    data = "aé中😀z".encode()
    for cut in range(len(data) + 1):
        s = bpe.Utf8Stream()
        assert s.feed(data[:cut]) + s.feed(data[cut:]) + s.close() == "aé中😀z"


# --- fingerprints


def test_links_give_the_components_of_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    values = sorted({int(base[rng.integers(5)]) ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 7)).tolist())) for _ in range(1500)})
    a = np.array(values, np.uint64)
    parent = list(range(len(a)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= simhash.RADIUS) + i + 1:
            parent[root(int(j))] = root(i)
    want = {}
    for i, v in enumerate(values):
        want.setdefault(root(i), set()).add(v)
    df = spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp long")
    for tile in (60, 8192):
        got = {}
        for r in components(simhash.links(df, tile)).collect():
            got.setdefault(r.root, set()).add(r.node % 2**64)
        assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values() if len(x) > 1}


def test_small_buckets_share_their_planes():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 4)).tolist())) for _ in range(2000)]
    values = base[rng.integers(0, 40, 2000)] ^ np.array(flips, np.uint64)
    sizes = np.sort(rng.integers(2, simhash.SMALL + 1, 80))[::-1]
    sizes = sizes[np.cumsum(sizes) <= len(values)]
    values = values[: sizes.sum()]
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    for radius in (0, 1, 2, 3, 6):
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
        want = {(i, j) for i, j in np.argwhere(near & (bucket[:, None] == bucket[None, :])).tolist() if i < j}
        u, v = simhash.bucket_pairs(values, sizes, radius)
        assert set(zip(u.tolist(), v.tolist(), strict=True)) == want and len(u) == len(want) > 0


def test_fingerprints_and_components_equal_brute_force(spark, sf_dir, monkeypatch):
    """The whole query, by another way: bits added one by one, all pairs of fingerprints compared."""
    import xxhash

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {}
    for i, t in texts.items():
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
        grams = [" ".join(ws[a : a + 3]) for a in range(len(ws) - 2)] or [" ".join(ws)] * bool(ws)
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    group = {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op7_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{prints[i]:016x}", group[i]) for i in texts}


def test_planes_are_compared_on_documents(spark, monkeypatch):
    """Buckets of a few members go through the planes too."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    table = simhash.buckets(simhash.fingerprints(docs).select("fp").distinct()).coalesce(1).toArrow()
    compared = []
    real = simhash.bucket_pairs
    monkeypatch.setattr(simhash, "bucket_pairs", lambda values, sizes: compared.append(len(values)) or real(values, sizes))
    found = sum(b.num_rows for b in simhash._bucket_links(iter(table.to_batches(512))))
    assert sum(compared) == table.num_rows > 100 and found > 0


def test_kept_documents_equal_brute_force(spark):
    """Edited copies go, whatever their fingerprints' distance; the shared frame makes shingles that many texts have."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    frame_ = " ".join(word() for _ in range(25))
    texts = [None, "", " ", "one two", "one two", "One  TWO", "one two three"]
    for _ in range(60):
        ws = [word() for _ in range(rng.choice([4, 6, 9, 40, 150]))]
        texts.append(" ".join(ws) + " " + frame_)
        for _ in range(rng.randrange(3)):
            edited = list(ws)
            for _ in range(rng.randrange(1, 5)):
                edited[rng.randrange(len(ws))] = word()
            texts.append(" ".join(edited) + " " + frame_)

    def grams(t):
        ws = (t or "").lower().split()
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()

    sets = [grams(t) for t in texts]
    group = list(range(len(texts)))
    far = 0
    for j in range(len(texts)):
        for i in range(j):
            union = sets[i] | sets[j]
            if not union or len(sets[i] & sets[j]) >= 0.8 * len(union):
                far += (simhash.fingerprint(texts[i] or "") ^ simhash.fingerprint(texts[j] or "")).bit_count() > simhash.RADIUS
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    assert far > 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == sorted(set(group))


def test_sketches_never_differ_in_more_bits_than_sets():
    from revlens.llm import shingle_join

    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 50, 400, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for changed in (0, 1, n // 10, n // 2, n):
            b = np.unique(np.concatenate([a[changed:], rng.integers(0, 1 << 63, changed, dtype=np.uint64)]))
            bits = int(np.bitwise_count(shingle_join.sketch(a) ^ shingle_join.sketch(b)).sum())
            assert bits <= len(np.setxor1d(a, b))
            assert bits > 0 or changed != 1


def test_bit_sliced_distances():
    a = np.random.default_rng(2).integers(0, 2**63, 200, dtype=np.uint64)
    planes = simhash.bit_planes(a)
    for radius in (1, 2, 3, 5, 25, 30):
        marks = np.unpackbits(simhash.within(planes, int(a[0]), radius).astype("<u8").view(np.uint8), bitorder="little")[: len(a)]
        assert (np.flatnonzero(marks) == np.flatnonzero(np.bitwise_count(a ^ a[0]) <= radius)).all()


# --- repeated strings


def brute_removed(texts, m=200):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[s : s + m] for b in data for s in range(len(b) - m + 1))
    out = []
    for b in data:
        covered = np.zeros(len(b), bool)
        for s in range(len(b) - m + 1):
            if count[b[s : s + m]] > 1:
                covered[s : s + m] = True
        runs = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        out.append((len(b), int(covered.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~covered].tobytes()).hexdigest()))
    return out


def mosaic(n, seed=1):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(2000)) for _ in range(5)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            b, k = rng.choice(base), rng.choice([50, 199, 200, 201, 260, 400])
            at = rng.randrange(len(b))
            parts.append(b[at : at + k] + rng.choice(["", "x", "yé", "zzz"]))
        texts.append("".join(parts))
    return [*texts, "a" * 700, "ab" * 300, "", None, "x" * 199, texts[0], texts[0], "é" * 300]


def test_removed_equals_brute_force(spark):
    texts = mosaic(150)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts)


def test_stripped_texts_equal_brute_force(spark):
    texts = mosaic(60)
    df = spark.createDataFrame([(i if i % 9 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, place long").repartition(4)
    got = {r.place: r.text for r in suffix_dedup.strip(df).collect()}
    assert len(got) == len(texts)
    for i, ((_, n_removed, _, kept), t) in enumerate(zip(brute_removed(texts), texts, strict=True)):
        if n_removed == 0:
            assert got[i] == t
        elif "é" not in t:
            assert hashlib.sha256(got[i].encode()).hexdigest() == kept


def test_very_long_texts_of_one_character(spark):
    """Memory of a worker stays in bounds on a text with an anchor at every byte; other texts share its strings."""
    texts = ["a" * 6_000_000, "b" * 199 + "a" * 200 + "c", "ab" * 100_000, "d" + "ba" * 150]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.removed(df).collect()}
    assert got == {0: (6_000_000, 6_000_000, 1), 1: (400, 200, 1), 2: (200_000, 200_000, 1), 3: (301, 300, 1)}


def test_a_string_twice_in_a_very_long_text(spark, monkeypatch):
    """Occurrences in different parts of one text are found."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    again = word(230)
    text = word(1_200_000) + again + word(1_100_000) + again + word(100)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = suffix_dedup.removed(df).first()
    assert r.n_spans == 2 and 460 <= r.n_removed <= 464


def test_a_hot_group_cut_by_runs_and_buckets(monkeypatch):
    """Spans of one bucket equal local spans plus the comparison across boundaries when the group is cut."""
    rng = random.Random(4)
    common = "".join(rng.choice("abcdefgh ") for _ in range(300))
    texts = [("".join(rng.choice("xyz") for _ in range(90)) + common[rng.randrange(40) :]).encode() for _ in range(60)]
    from revlens.llm import anchors

    text, place, first, last, ctx = (x.tolist() for x in anchors.find(texts))
    often = {c for c, n in Counter(ctx).items() if n > 1}
    rows = [(texts[i][p : p + 16], texts[i][a : b + 200], p - a, False, i, 0, a) for i, p, a, b, c in zip(text, place, first, last, ctx, strict=True) if c in often]
    rows.sort(key=lambda r: (r[0], r[4]))
    names = ["lead", "seg", "off", "many", "k", "th", "start", "hot"]

    def spans_of(parts):
        open_, spans = {}, []
        for part in parts:
            batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[(*r, True) for r in part], strict=True)], names)
            for out in suffix_dedup._buckets(iter([batch])):
                for r in out.to_pylist():
                    if r["f1"] is None:
                        spans.append((r["k"], r["start"], r["end"]))
                    else:
                        n, at = open_.setdefault((r["f1"], r["f2"]), [0, []])
                        open_[r["f1"], r["f2"]][0] = n + r["n"]
                        if r["k"] is not None:
                            at.append((r["k"], r["start"], r["end"]))
        spans += [x for n, at in open_.values() if n > 1 for x in at]
        return {k: suffix_dedup.union([(a, b) for i, a, b in spans if i == k]) for k in range(len(texts))}

    whole = spans_of([rows])
    assert sum(map(len, whole.values())) > 30
    assert spans_of([rows[::2], rows[1::2]]) == whole
    monkeypatch.setattr(suffix_dedup, "BUCKET", 7)
    assert spans_of([rows[:31], rows[31:]]) == whole


# --- nearest examples, licences, URLs, top k


def test_nearest_examples_are_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    rng = np.random.default_rng(2)
    n, vocabulary = 1500, 400
    sizes = rng.integers(0, 20, n)
    rows = [rng.choice(vocabulary, s, replace=False, p=(w := 1 / np.arange(1, vocabulary + 1)) / w.sum()) for s in sizes]
    terms, counts = np.concatenate(rows), rng.integers(1, 4, sizes.sum())
    labels = rng.integers(0, 2, n)
    index = toxicity.build(np.arange(n), labels, sizes, terms, counts, np.array([7, 30, 200]), frozenset(), (1.0, 1.0))
    assert 0 < index.dense.shape[1] < len(index.terms)
    full = np.zeros((n, len(index.terms)))
    full[:, index.column >= 0] = index.dense
    of = np.repeat(np.arange(len(index.terms)), np.diff(np.append(index.starts[:, 0], len(index.docs))))
    full[index.docs, of] = index.weights
    assert np.allclose((full**2).sum(axis=1), (np.bincount(index.docs, minlength=n) + (index.dense > 0).sum(axis=1)) > 0)
    queries = [(f, full[i, f]) for i in range(0, n, 3) if len(f := np.flatnonzero(full[i]))]
    read = []
    for (f, w), (best, cosines) in zip(queries, index.nearest(queries, read=read), strict=True):
        true = np.round(full[:, f] @ w, 12)
        want = np.lexsort((np.arange(n), -true))[: toxicity.NEIGHBOURS]
        want = want[true[want] > 0]
        assert best.tolist() == want.tolist() and np.allclose(cosines, true[want])
    assert min(read) < 5  # blocks out of 24


def test_isotonic():
    x, y = toxicity.isotonic(np.array([0, 1, 2, 3.0]), np.array([0, 1, 0, 1.0]), np.ones(4))
    assert y.tolist() == [0, 0.5, 0.5, 1]


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    rows = toxicity.op5_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id").join(docs, "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic == 1]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic) > 50
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.98
    assert all(r.evidence for r in rows if r.text.strip())  # every text has a word in common with the examples


def test_neighbours_in_the_corpus_equal_brute_force(spark):
    """Evidence of whole texts by another way: TF-IDF vectors as dictionaries, all cosines."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    index = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    terms = lambda t: Counter(x for w in words(t) for x in [w, *(b for b in toxicity.beginnings(w) if b in index.stems)])
    examples = {i: terms(texts[i]) for i in index.ids.tolist()}
    df = Counter(t for c in examples.values() for t in c)
    leans = {t for t in df if t in index.stems} | {t for t in df if index.idf[np.searchsorted(index.terms, toxicity.number(t))] > 1.0001 * (np.log((1 + len(examples)) / (1 + df[t])) + 1)}
    weight = lambda t, n: (1 + np.log(n)) * (np.log((1 + len(examples)) / (1 + df[t])) + 1) * (toxicity.RELEVANCE if t in leans else 1)

    def unit(c):
        v = {t: weight(t, n) for t, n in c.items() if t in df}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = {i: unit(c) for i, c in examples.items()}
    scored = {r.doc_id: r.evidence for r in toxicity.score(docs.select("doc_id", "text"), labels).where("doc_id % 7 = 0").collect()}
    assert len(scored) > 100
    for i, evidence in scored.items():
        q = unit(terms(texts[i]))
        best = sorted((sum(x * v.get(t, 0) for t, x in q.items()) for v in vectors.values()), reverse=True)[:3]
        got = [float(x.split(":")[2]) for x in evidence.split(",") if x]
        assert np.allclose(got, [b for b in best if b > 0], atol=1e-4), i


def test_license_predictions():
    m = licenses.train(["one of the words and others", "a long walk under the trees with all of them"] * 50)
    assert m.predict("This work is licensed under the GNU General Public License, version 3.")[0] == "gpl"
    assert m.predict("Some text. Released under the MIT License. More text.")[0] == "mit"
    assert m.predict("Licensed under the Foobar License 9")[0] == licenses.UNKNOWN
    assert m.predict("the walk under the trees") is None


# Texts that aren't variations of the templates: notices as they stand in files, wrapped, in comments, shortened.
NOTICES = {
    "mit": ["SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights",
            "// Permission is hereby granted, free of charge, to any person obtaining a copy", "This project is released under the MIT License, see LICENSE."],
    "apache-2.0": ["# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions", "modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright"],
    "gpl": ["This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by", " * You should have received a copy of the GNU General Public License\n * along with this program.  If not, see <http://www.gnu.org/licenses/>."],
    "lgpl": ["This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation"],
    "isc": ["Available under the ISC license. Released under the ISC license.", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted"],
    "cc-by-sa": ["Text is available under the Creative Commons Attribution-ShareAlike 4.0 License"],
    "cc-by": ["This article is licensed under a Creative Commons Attribution 4.0 International License, which permits use"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at"],
    "proprietary": ["Copyright 2019 Example Ltd. All rights reserved."],
}
CLEAN = [
    "The committee met under the old trees and the copy of the report was read to all persons.", "You can obtain a copy of the timetable at the station, without charge, on any day.", "Software is hard; the following conditions apply to good work: time and rest.",
    "In the source of the river and in binary stars, with or without the moon, forms change.", "The general public was let in at noon.", "A copy of the map is in the file on the desk.",
]


def test_licence_notices_as_they_stand():
    m = licenses.train(["one of the words and others", "a long walk under the trees with all of them", "he gave them a copy of the book"] * 50)
    missed = [(family, n, m.all(n)) for family, notices in NOTICES.items() for n in notices for _, _, block in licenses.blocks(n) if family not in [f for f, _, _ in m.all(block)]]
    assert len(missed) <= 2, missed
    assert [x for x in CLEAN if m.all(x)] == []
    both = [f for f, _, _ in m.all("Dual licensed: released under the MIT license, or licensed under the Apache License, Version 2.0")]
    assert both == ["apache-2.0", "mit"]


def test_whole_license_query_equals_the_model_on_each_block(spark):
    """Counts, families and spans of the query by another way of cutting the texts; long blocks in windows, nulls, repeats."""
    long = "word " * 5000 + NOTICES["apache-2.0"][0].replace("#", "") + " word" * 5000
    rows = [(1, "Title\n\n" + NOTICES["mit"][1] + "\n\nThe end."), (2, None), (3, ""), (4, long), (4, long), (None, NOTICES["gpl"][1]), (6, "\n\n".join(x for v in NOTICES.values() for x in v))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    m = licenses.train(licenses.background(df))
    got = sorted(tuple(r) for r in licenses.scan(df, m).selectExpr("coalesce(doc_id, -1)", "n_paragraphs", "n_licenses", "families", "spans").collect())
    want = []
    for i, t in rows:
        hits, n = [], 0
        for found in re.finditer(r"(?:[^\n]+(?:\n|$))+", t or ""):
            block = found.group().rstrip("\n")
            n += 1
            hits += [f"{f}:{found.start()}:{found.start() + len(block)}:{p:.3f}" for f, p, _ in m.all(" ".join(x.strip(licenses._MARKS) for x in block.split("\n")))]
        want.append((-1 if i is None else i, n, len(hits), ",".join(sorted({h.split(":")[0] for h in hits})), ",".join(hits)))
    assert got == sorted(want)
    by = {r[0]: r[3] for r in got}
    assert by[1] == "mit" and by[2] == by[3] == "" and by[4] == "apache-2.0" and by[-1] == "gpl"


def test_url_edge_cases(spark):
    rows = [(1, "http://A.Example.COM/en/7x?q", "z"), (2, None, "z"), (3, "no scheme", "z"), (None, "x://com", "z"), (5, "x://com/en/", "z"), (5, "x://com/en/", "z"), (6, "x://notcom/en/", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, url_filter.rule_table(spark)).collect())
    assert got == [("1", "a.example.com", "/en/7x", "example.com/en/7", "allow"), ("2", "", "", None, "allow"), ("3", "", "", None, "allow"), ("5", "com", "/en/", "com/en/", "block"),
                   ("5", "com", "/en/", "com/en/", "block"), ("6", "notcom", "/en/", None, "allow"), ("None", "com", "", None, "allow")]
    assert url_filter.filter_urls(pages.limit(0), url_filter.rule_table(spark)).count() == 0


def test_a_long_list_of_urls(spark):
    """100,000 entries: the filter lets few others pass, and none of those decides anything."""
    listed = spark.range(100_000).selectExpr("concat('h', id, '.org') as rule_host", "concat('/p', id % 100) as rule_path", "'block' as verdict")
    blocks = url_filter.blocks_for(100_000)
    pages = spark.range(40_000).selectExpr("id as page_id", "case when id % 4 = 0 then concat('http://a.h', id, '.org/p', id % 100, '/x') when id % 4 = 1 then null else concat('http://x', id, '.net/p', id % 7) end as url")
    got = {r.verdict: r.n for r in url_filter.filter_urls(pages, listed).groupBy("verdict").count().withColumnRenamed("count", "n").collect()}
    assert got == {"block": 10_000, "allow": 30_000}
    others = pages.where("page_id % 4 > 1").selectExpr("concat('x', page_id, '.net') as host", "concat('/p', page_id % 7) as path")
    passed = url_filter.possible_hits(others, listed, blocks).where("size(hits) > 0").count()
    assert passed < 0.02 * 20_000


def exact_top_k(rows, every=100, k=10):
    """By Python's integers, each row a query of its own."""
    import math
    from fractions import Fraction

    fine = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(fine):
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for m, (i, w) in enumerate(fine) if m != n)[:k]
            out += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_edge_cases(spark, duck):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [1.0]), (6, [inf, 0.0]), (7, [1.0, 2.0]), (None, [1.0, 1.0]), (8, []), (9, [-1.0, 0.5, 9.0])]
    rows += [(0, [3.0, 1.0]), (1, [2e6, 1.0]), (10, [-5e6, 2.0**20]), (100, [1e9, -1.0]), (200, []), (11, [3.4e38, 1.0]), (12, [3.3e38, 1.0]), (13, [-1e300, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in top_k.top_k(df, shard=4).collect())
    assert got == exact_top_k(rows) and (0, 1, 11, 2**63 - 1) in got and sum(r[:2] == (0, 1) for r in got) == 2
    assert top_k.top_k(df.limit(0)).count() == 0
    import duckdb

    small = [r for r in rows if r[0] not in (11, 12, 13)]
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding double[])")
    con.executemany("insert into embeddings values (?, ?)", small)
    assert sorted(con.execute(top_k.ORACLE_SQL).fetchall()) == exact_top_k(small)


def test_top_k_prunes_and_stays_exact(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 40))
    rows = [(i, (centres[i % 12] + 0.2 * rng.normal(size=40)).tolist()) for i in range(600)]
    monkeypatch.setattr(top_k, "BLOCK_BYTES", 40 * 8 * 64)
    monkeypatch.setattr(top_k, "QUERIES", 4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(tuple(r) for r in top_k.top_k(df, every=20, shard=100).collect()) == exact_top_k(rows, 20)
    m = top_k.integers(np.array([v for _, v in rows]).T)
    n, counts = np.arange(600), []
    list(top_k.search_blocks(m[:, ::20], m, n[::20], n, n, survived=counts))
    assert np.mean([c[-1] for c in counts]) < 0.3 * 600


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
    assert corpus_pipeline.run(spark, sf_dir).where("length > 4096").count() == 0
