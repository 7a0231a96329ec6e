"""Byte-level BPE by a lazily determinised finite-state transducer.

A configuration of the nondeterministic machine is (trie node of the token being read, token before it). On a byte
every configuration moves in the trie; where a token ends, it is chosen if it and the token before it stay apart when
their bytes are merged by rank, and exactly one token ends each prefix that way. The set of configurations is one state
of the deterministic machine; states and transitions are built when first needed and kept. Each transition yields the
token that ends there; once a state has a single configuration, all tokens up to it are settled and emitted. A
configuration lives no longer than the longest token, which bounds the lookahead.

Decoding concatenates the tokens' bytes; a machine with the states of UTF-8 holds back an unfinished character at the
end of a block, so text streams out without ever splitting a code point.

Defined results: a null text is an empty one, with no tokens; every whole text is encoded, whatever its length (in one
task's memory, with its ids); of merges of equal rank the leftmost comes first; ids are cast to long; repeated rows and
null ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import ready, table, text_or_empty

VOCABULARY = "byte_bpe_50k.tiktoken"
#: States that a worker keeps before it starts afresh; bytes of each of its two tables of parts of text with their ids,
#: longest part that is kept, and what an entry takes beside its contents.
KEPT_STATES, KEPT_BYTES, LONGEST_KEPT, _ENTRY = 200_000, 128 << 20, 256, 200
#: Bytes read at least before settled tokens are emitted; most matches of the pattern are shorter.
SETTLE = 64
#: Tokens decoded at a time.
DECODE_BLOCK = 1 << 16
#: Unicode's White_Space, as the pattern's \s has it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Encodes one match of the pattern after another."""

    def __init__(self, ranks: dict[bytes, int], keep: int = KEPT_STATES) -> None:
        self._ranks, self._keep = ranks, keep
        self._bytes = {v: k for k, v in ranks.items()}
        self._child: dict[tuple[int, int], int] = {}
        self._token = [-1]  # by trie node
        for word, rank in ranks.items():
            node = 0
            for c in word:
                node = self._child.setdefault((node, c), len(self._token))
                if node == len(self._token):
                    self._token.append(-1)
            self._token[node] = rank
        self._inner = [False] * len(self._token)
        for node, _ in self._child:
            self._inner[node] = True
        self._length = {v: len(k) for k, v in ranks.items()}
        self._apart: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        # a state: its configurations; a configuration: (trie node, the token before, -1 for none)
        start = ((0, -1),)
        self._states = [start]
        self._number = {start: 0}
        self._next: dict[int, tuple[int, int]] = {}

    def merged(self, word: bytes) -> list[int]:
        """Ids of `word` by repeated merging of the adjacent pair of least rank: the definition."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((self._ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self._ranks[p] for p in parts]

    def _stay_apart(self, before: int, token: int) -> bool:
        key = (before, token)
        found = self._apart.get(key)
        if found is None:
            if len(self._apart) > 4 * self._keep:
                self._apart.clear()
            first = self._bytes[before] if before >= 0 else b""
            found = self._apart[key] = self.merged(first + self._bytes[token]) == [t for t in key if t >= 0]
        return found

    def _step(self, state: int, c: int) -> tuple[int, int]:
        """The next state, and the token that ends here in the encoding of the prefix."""
        moved, ended = [], -1
        for node, before in self._states[state]:
            node = self._child.get((node, c), -1)
            if node < 0:
                continue
            token = self._token[node]
            if token >= 0 and ended < 0 and self._stay_apart(before, token):
                ended = token
            if self._inner[node]:
                moved.append((node, before))
        new = (*moved, (0, ended))  # every prefix has an encoding, so a token has ended
        number = self._number.setdefault(new, len(self._states))
        if number == len(self._states):
            self._states.append(new)
        found = self._next[state << 8 | c] = (number, ended)
        return found

    def encode(self, word: bytes) -> list[int]:
        whole = self._ranks.get(word)
        if whole is not None:
            return [whole]
        if len(self._states) > self._keep:
            self._reset()
        out: list[int] = []
        ends: list[int] = []  # the tokens that end at each byte since the last settled place
        state, get, states = 0, self._next.get, self._states
        for c in word:
            found = get(state << 8 | c)
            state, token = found if found is not None else self._step(state, c)
            ends.append(token)
            if len(ends) >= SETTLE and len(states[state]) == 1:
                # one configuration is left, so all tokens up to here are settled
                out += self._settled(ends)
                ends.clear()
        return out + self._settled(ends) if out else self._settled(ends)

    def _settled(self, ends: list[int]) -> list[int]:
        i, out, length = len(ends), [], self._length
        while i:
            token = ends[i - 1]
            out.append(token)
            i -= length[token]
        out.reverse()
        return out


class Utf8Stream:
    """Incremental UTF-8: `feed` returns the text of all whole characters so far; malformed bytes become U+FFFD."""

    def __init__(self) -> None:
        self._held = b""

    @staticmethod
    def unfinished(block: bytes) -> int:
        """How many bytes at the end begin a character that the block doesn't finish (0 to 3)."""
        for back in range(1, min(3, len(block)) + 1):
            c = block[-back]
            if c & 0xC0 != 0x80:  # the state after a leading byte awaits 0 to 3 continuation bytes
                needs = 0 if c < 0x80 else 2 if 0xC2 <= c < 0xE0 else 3 if 0xE0 <= c < 0xF0 else 4 if 0xF0 <= c < 0xF5 else 0
                return back if needs > back else 0
        return 0

    def feed(self, block: bytes) -> str:
        block = self._held + block
        n = len(block) - self.unfinished(block)
        self._held = block[n:]
        return block[:n].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self._held = self._held, b""
        return rest.decode("utf-8", "replace")


class ByteBpe:
    """Whole texts to ids and back."""

    def __init__(self, path: str, pattern: str, keep: int = KEPT_BYTES) -> None:
        import re

        import regex

        ranks = read_ranks(path)
        self._transducer = Transducer(ranks)
        self._bytes = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            self._bytes[rank] = word
        # \S and \s outside of classes, and \s inside of one, become explicit classes
        explicit = pattern.replace("[^\\s", f"[^{SPACE}").replace("\\S", f"[^{SPACE}]").replace("\\s", f"[{SPACE}]")
        self._match = regex.compile(explicit).findall
        # no match crosses the end of such a part, and within a part the matches are the same as in the whole text
        self._parts = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        self._keep, self._held, self._known, self._old = keep, 0, {}, {}

    def _part(self, part: str) -> bytes:
        encode = self._transducer.encode
        ids = [i for word in self._match(part) for i in encode(word.encode("utf-8", "surrogatepass"))]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        parts = self._parts(text)
        out = list(map(self._known.get, parts))
        for i, found in enumerate(out) if None in out else ():
            if found is None:
                out[i] = self._met(parts[i])
        return b"".join(out)

    def _met(self, part: str) -> bytes:
        """Ids of a part that the first table may lack; a full table becomes the old one, from which parts come back."""
        found = self._known.get(part)
        if found is None:
            found = self._old.pop(part, None)
            if found is None:
                found = self._part(part)
            if len(part) <= LONGEST_KEPT:
                self._held += 2 * len(part) + len(found) + _ENTRY
                if self._held > self._keep:
                    self._old, self._known, self._held = self._known, {}, 0
                self._known[part] = found
        return found

    def decode_blocks(self, ids: bytes) -> Iterator[bytes]:
        """The bytes of a block of tokens after another."""
        numbers = np.frombuffer(ids, "<u4")
        for a in range(0, len(numbers), DECODE_BLOCK):
            yield b"".join(map(self._bytes.__getitem__, numbers[a : a + DECODE_BLOCK].tolist()))

    def decode(self, ids: bytes) -> Iterable[str]:
        stream = Utf8Stream()
        for block in self.decode_blocks(ids):
            yield stream.feed(block)
        yield stream.close()


_coders: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """One coder per worker process and vocabulary."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBpe(path, pattern)
    return _coders[path, pattern]


def _round_trip(path: str, pattern: str):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            for t in batch.column("t"):
                ids = bpe.encode(t.as_py())
                n.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                decoded = hashlib.sha256()
                for block in bpe.decode_blocks(ids):
                    decoded.update(block)
                of_bytes.append(decoded.hexdigest())
            columns = [batch.column("id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def _encoder(path: str, pattern: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            ids = [np.frombuffer(bpe.encode(t.as_py()), "<u4").astype(np.int32) for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return encode


def _decoder(path: str, pattern: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            texts = ["".join(bpe.decode(np.array(x.as_py() or [], "<u4").tobytes())) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return decode


def vocabulary() -> tuple[str, str]:
    """Path of the ranks, and the pattern that splits a text."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ready(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids."""
    return _rows(docs, id_col, text_col).mapInArrow(_encoder(*vocabulary()), "doc_id long, ids array<int>")


def decode(encoded: DataFrame) -> DataFrame:
    """doc_id, text of what `encode` gave."""
    return ready(encoded.sparkSession) and encoded.select("doc_id", "ids").mapInArrow(_decoder(*vocabulary()), "doc_id long, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number and hash of each text's ids, and the hash of what they decode to."""
    return _rows(docs, id_col, text_col).mapInArrow(_round_trip(*vocabulary()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
