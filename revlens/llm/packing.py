"""Best-fit packing planned on a histogram of lengths.

Tokens: a document's ids come from a public word-level BPE vocabulary, plus an end id. The tokenizer drops white
space and never joins across it, so a text's ids are those of its white-space separated chunks; the ids of chunks
are kept in a table of bounded bytes per Python worker. Chunks of printable Latin-1 are split by the vocabulary's rule
and merged by rank; all others go to the tokenizer itself.

Plan: the histogram of piece lengths has at most `capacity` entries, whatever the corpus; best-fit decreasing runs on
its counts on the driver and yields ranges of slots, (length, first rank, slots, first sequence, slots per sequence,
offset). Documents are never moved to the driver: each piece gets its rank within its length (a prefix sum over
hash buckets, then a row number within length and bucket, so a common length is no hot task) and takes the slot of
that rank by a join on the length.

Defined results: a null or empty text is the end id alone; repeated rows and null ids are packed like any others;
an empty table gives an empty result; a text longer than a sequence is cut into full pieces and a rest, whatever its
length (a text is held in one task's memory with its ids); pieces of equal length are interchangeable, so ties in rank
are broken by id, piece, start and hash, and true repeats take neighbouring slots in any order; ids are cast to long,
and ids that aren't numbers raise an error under ANSI mode; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlens.llm.common import ready, released, table, text_or_empty, written

CAPACITY = 4096
END_ID = 1
#: Bytes of the table of known chunks in a Python worker, which has two of them at most; longer chunks aren't kept.
KEPT_BYTES, LONGEST_KEPT = 64 << 20, 256
#: Bytes that an entry of the table takes beside its contents, about.
_ENTRY = 180
#: Buckets of a length over which its pieces are ranked, at least; pieces of a length and bucket, about, beyond that.
BUCKETS, BUCKET_ROWS = 32, 200_000
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


# How the vocabulary's file normalises a text and splits it into words.
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _byte_chars() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 up."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


#: The byte that ends a word: no UTF-8 text has it.
_END = b"\xff"
_END_OF_WORD = "</w>"


def _symbol(token: str, of: dict[str, int]) -> bytes:
    ends = token.endswith(_END_OF_WORD)
    return bytes(of[c] for c in (token.removesuffix(_END_OF_WORD) if ends else token)) + (_END if ends else b"")


@lru_cache(maxsize=4)
def merge_ranks(path: str) -> tuple[dict[bytes, int], list[int]] | None:
    """(ranks, ids): rank of each symbol in the order in which they are merged, and the id of each rank.

    None if the file isn't a byte-level BPE with word ends, or splits its words in another way than `_piece`. A word is
    its bytes and `_END`; the pairs (byte, `_END`) come first, so that the rest merges as the vocabulary's symbols do. A
    symbol that the listed merges don't build from its own bytes never occurs and has no rank; with the others, merging
    whatever adjacent symbols form a symbol is the same as following the list.
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model = file["model"]
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != _END_OF_WORD or (file["normalizer"], file["pre_tokenizer"]) != (_NORMAL, _SPLIT):
        return None
    of = _byte_chars()
    vocabulary = model["vocab"]
    base = [bytes([b]) + end for end in (_END, b"") for b in range(256)]
    ids = [vocabulary.get(c + end, -1) for end in (_END_OF_WORD, "") for c in sorted(of, key=of.__getitem__)]
    ranks = {x: i for i, x in enumerate(base)}
    listed = {}
    for i, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        listed[_symbol(a, of), _symbol(b, of)] = (i, a + b)

    def whole(symbol: bytes) -> bool:
        parts = [symbol[i : i + 1] for i in range(len(symbol))]
        if parts[-1] == _END:
            parts[-2:] = [parts[-2] + _END]
        while len(parts) > 1:
            pairs = [listed.get(x, (len(listed),))[0] for x in zip(parts, parts[1:], strict=False)]
            i = pairs.index(min(pairs))
            if pairs[i] == len(listed):
                return False
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return True

    for (a, b), (_, token) in listed.items():
        if a + b not in ranks and whole(a + b):
            ranks[a + b] = len(ids)
            ids.append(vocabulary[token])
    return ranks, ids


# the same for printable Latin-1, whose letters have no other normal form and one lower case
_piece = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼-¾]+").findall


class WordEncoder(dict):
    """Ids of texts as little-endian unsigned 32-bit bytes; as a dict, of chunks that were met.

    The table is bounded in bytes: when it is full it becomes the `_old` one, from which chunks come back when they are
    met again, so frequent chunks are never encoded anew.
    """

    def __init__(self, path: str, ranks: tuple[dict[bytes, int], list[int]] | None, keep: int = KEPT_BYTES) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._keep, self._held = keep, 0
        self._old: dict[bytes, bytes] = {}
        self._merge, self._id = None, []
        if ranks is not None:
            import tiktoken

            self._id = [i.to_bytes(4, "little", signed=True) for i in ranks[1]]
            self._merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks[0], special_tokens={})._core_bpe.encode_single_piece

    def encode(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        # the tokenizer lower-cases, so A-Z may be lower-cased first; not where the text may name a special token
        for t in texts:
            yield b"".join(map(self.__getitem__, (t if b"<|" in t else t.lower()).split()))

    def __missing__(self, chunk: bytes) -> bytes:
        found = self._old.pop(chunk, None)
        if found is None:
            found = self._encoded(chunk)
        if len(chunk) <= LONGEST_KEPT:
            self._held += len(chunk) + len(found) + _ENTRY
            if self._held > self._keep:
                self._old = dict(self)
                self.clear()
                self._held = 0
            self[chunk] = found
        return found

    def _encoded(self, chunk: bytes) -> bytes:
        merge, of = self._merge, self._id
        if merge is not None and chunk.isalpha():  # a-z only, or A-Z beside a special token
            return b"".join([of[r] for r in merge(chunk.lower() + _END)])
        text = chunk.decode("utf-8", "replace")
        if merge is None or not text.isprintable() or max(text) > "ÿ" or b"<|" in chunk:
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        # what the split leaves is met in many chunks, as a word is with a comma, a full stop or none
        parts = [p.encode() for p in _piece(text.lower())]
        if len(parts) > 1:
            return b"".join([self[p] for p in parts])
        return b"".join([of[r] for r in merge(parts[0] + _END)])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str, ranks: tuple[dict[bytes, int], list[int]] | None) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path, ranks)
    return _encoders[path]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cutter(path: str, capacity: int, end: int, ranks):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, coder = np.array([end], "<u4").tobytes(), encoder(path, ranks.value)
        for batch in batches:
            sizes, crcs = [], []
            texts = batch.column("t").cast(pa.binary())
            for ids in coder.encode(t.as_py() for t in texts):
                ids += tail
                sizes.append(len(ids) // 4)
                crcs += [zlib.crc32(ids)] if sizes[-1] <= capacity else [zlib.crc32(ids[a : a + 4 * capacity]) for a in range(0, len(ids), 4 * capacity)]
            size = np.array(sizes, np.int64)
            n = -(-size // capacity)  # pieces of each document
            of = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            length = np.minimum(size[of] - piece * capacity, capacity)
            columns = [batch.column("id").take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document with their lengths."""
    path = path or vocabulary_path()
    ranks = ready(docs.sparkSession).sparkContext.broadcast(merge_ranks(path))  # as large as the vocabulary
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t"))
    return rows.mapInArrow(released(_cutter(path, capacity, end, ranks)), _PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing on counts: (length, first rank, slots, first sequence, slots per sequence, offset).

    Sequences with the same room are a class of consecutive numbers; an item goes to the least room that holds it, so
    a class is filled with one length as far as it goes before the next class is touched.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first sequence, sequences)
    slots: list[tuple[int, int, int, int, int, int]] = []
    n_sequences = 0

    def fill(length: int, rank: int, left: int, first: int, count: int, free: int) -> int:
        """Places up to `left` items in a class; the number placed."""
        per = free // length
        whole = min(count, left // per)
        placed = whole * per
        if whole:
            slots.append((length, rank, placed, first, per, capacity - free))
            room[free - per * length].append((first, whole))
        rest = min(left - placed, per) if whole < count else 0
        if rest:
            slots.append((length, rank + placed, rest, first + whole, rest, capacity - free))
            room[free - rest * length].append((first + whole, 1))
        used = whole + bool(rest)
        if used < count:
            room[free].append((first + used, count - used))
        return placed + rest

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        for free in range(length, capacity + 1):
            while left and room[free]:
                first, count = room[free].pop()
                done = fill(length, rank, left, first, count, free)
                left, rank = left - done, rank + done
            if not left:
                break
        if left:
            count = -(-left // (capacity // length))
            fill(length, rank, left, n_sequences, count, capacity)
            n_sequences += count
    return slots


def ranked(rows: DataFrame, buckets: int) -> DataFrame:
    """`rank` from 0 within each length, without gaps."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket")
    sums = counts.select(F.col("length").alias("l"), F.col("bucket").alias("b"), (F.sum("n").over(before) - F.col("n")).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    return (
        dealt.withColumn("r", F.row_number().over(within) - 1)
        .join(sums, (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b")))
        .withColumn("rank", F.col("base") + F.col("r"))
        .drop("bucket", "l", "b", "base", "r")
    )


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END_ID, **columns: str) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    spark = docs.sparkSession
    rows = written(pieces(docs, path, capacity, end, **columns))
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    by_length: dict[int, list[tuple]] = defaultdict(list)
    for length, *slot in plan(histogram, capacity):
        by_length[length].append(tuple(slot))
    slot = "array<struct<rank0:long,n:long,seq0:long,per:long,offset0:long>>"
    # rows of one length need the plan's ranges of that length only; their number is bounded by the histogram's size
    slots = spark.createDataFrame(list(by_length.items()), f"of long, slots {slot}")
    buckets = max(BUCKETS, sum(histogram.values()) // BUCKET_ROWS)
    mine = F.element_at(F.filter("slots", lambda s: (s["rank0"] <= F.col("rank")) & (F.col("rank") < s["rank0"] + s["n"])), 1)
    t = F.col("rank") - F.col("s.rank0")
    return (
        ranked(rows, buckets).join(slots, F.col("length") == F.col("of"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "rank", mine.alias("s"))
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("s.seq0") + F.floor(t / F.col("s.per"))).alias("sequence_id"),
            (F.col("s.offset0") + (t % F.col("s.per")) * F.col("length")).alias("offset"),
        )
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
