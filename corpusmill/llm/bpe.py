"""Byte-level BPE as a bounded-lookahead transducer, and its incremental decoder.

The merge list of a public tokenizer file gives its sufficient lookahead: how many bytes to the right
of a token can still change it. A long pretoken is merged in a window of fixed length; tokens
that end at least the lookahead before the window's end are stable and are emitted, and the window
starts again at the last of their ends. A text is read in pieces of bounded length that end where a
pretoken surely ends, so ids leave as they become stable, and decoding feeds their bytes to a byte-to-text state machine.
Memory besides a row's own text is constant: a piece and a bounded table of the short stretches seen,
which is emptied when a task ends.

Defined cases: a null text counts as empty and has no tokens; strings of special tokens inside a text
are encoded as the tokenizers library does, as the special token; an empty table gives an empty result; repeated
rows are encoded alike; very long texts, and very long runs without a space, go through piece by piece; other
columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import in_small_batches

#: Pretokens of the byte-level scheme (a fixed value: the tokenizer file's own pattern).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of stretches kept in a generation of the table (about, with Python's own overhead a stretch), and the longest that is kept, in characters.
TABLE_BYTES, OVERHEAD, TABLE_CHARS = 96 << 20, 200, 48
#: White space besides the space and the newline.
OTHER_SPACE = [*"\t\x0b\x0c\r\x85\xa0     　", *map(chr, range(0x2000, 0x200B))]
#: A pretoken up to so many bytes is merged without a heap; texts are read so many characters at a time.
SHORT, PIECE = 48, 1 << 16


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def sufficient_lookahead(rules: list[tuple[int, int, int]], length: list[int]) -> int:
    """rules: (left, right, merged) by falling priority; length: bytes of each token.

    Rule (u, v) can be pre-empted only by an earlier rule (s, w) whose s is v or ends v's merge tree,
    so it depends on at most len(w) bytes beyond v and on what that rule itself depends on.
    """
    right: dict[int, int] = {}
    reach: dict[int, int] = {}
    for u, v, m in rules:
        depends, s = 0, v
        while True:
            depends = max(depends, reach.get(s, 0))
            if s not in right:
                break
            s = right[s]
        reach[u] = max(reach.get(u, 0), length[v] + depends)
        right[m] = v
    return max(reach.values(), default=0)


class Transducer:
    """Encodes and decodes with one tokenizer file."""

    table_bytes = TABLE_BYTES

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        byte_of = {c: b for b, c in enumerate(symbols)}
        vocab = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.byte_ids = [vocab[c] for c in symbols]
        self.bytes_of = [b""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = token.encode() if token in self.specials else bytes(byte_of[c] for c in token)
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank = {(a, b): k for k, (a, b, _) in enumerate(rules)}
        self.merged = [m for *_, m in rules]
        self.lookahead = sufficient_lookahead(rules, [len(b) for b in self.bytes_of])
        longest = max(map(len, self.bytes_of))
        self.window = 2 * (self.lookahead + longest)
        self.names = [str(i) for i in range(len(self.bytes_of))]
        self.pattern = regex.compile(PATTERN)
        self.pretokens = self.pattern.findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.forget()

    def forget(self) -> None:
        """Empties the table: a reused Python worker then holds the tokenizer alone."""
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def merge(self, data: bytes) -> list[int]:
        """The tokens of a stretch: the earliest rule first, leftmost first."""
        ids, rank, never = [self.byte_ids[b] for b in data], self.rank.get, len(self.merged)
        if len(ids) > SHORT:
            return self._merge_long(ids)
        ranks = [rank(p, never) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            k = ranks.index(best)
            ids[k : k + 2] = [self.merged[best]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank((ids[k - 1], ids[k]), never)
            if k < len(ranks):
                ranks[k] = rank((ids[k], ids[k + 1]), never)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, k) for k in range(n - 1) if (r := rank((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            j = after[k] if ids[k] >= 0 else -1
            if j < 0 or rank((ids[k], ids[j])) != r:
                continue
            ids[k], ids[j] = self.merged[r], -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (r := rank((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return [i for i in ids if i >= 0]

    def stream(self, data: bytes) -> Iterator[int]:
        """The tokens of one pretoken of any length, emitted once stable."""
        at = 0
        while len(data) - at > self.window:
            end = 0
            for i in self.merge(data[at : at + self.window]):
                if end + len(self.bytes_of[i]) > self.window - self.lookahead:
                    break
                end += len(self.bytes_of[i])
                yield i
            at += end
        yield from self.merge(data[at:])

    def _stretch(self, text: str) -> bytes:
        """Ids (as unsigned little-endian 32-bit) of a stretch that starts and ends at pretoken bounds."""
        if (ids := self.older.get(text)) is not None:
            return self._keep(text, ids)
        parts = self.pretokens(text)
        ids = self._pretoken(text) if len(parts) == 1 else b"".join([self.table.get(p) or self._keep(p, self._pretoken(p)) for p in parts])
        return self._keep(text, ids)

    def _pretoken(self, text: str) -> bytes:
        return array("I", self.stream(text.encode())).tobytes()

    def _keep(self, text: str, ids: bytes) -> bytes:
        if len(text) <= TABLE_CHARS:
            if self.held > self.table_bytes:
                self.older, self.table, self.held = self.table, {}, 0
            self.table[text] = ids
            self.held += len(text) + len(ids) + OVERHEAD
        return ids

    def _plain(self, text: str) -> bytes:
        # A space before a non-space always starts a pretoken, and a newline that no space or newline
        # stands before is one; texts with other runs of white space go to the pattern itself.
        seen, stretch = self.table.get, self._stretch
        if "  " in text or " \n" in text or "\n\n" in text or any(c in text for c in OTHER_SPACE):
            parts = self.pretokens(text)
        else:
            parts = text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0") if "\0" not in text else self.pretokens(text)
        return b"".join([seen(p) or stretch(p) for p in parts if p])

    def _safe_cut(self, text: str, at: int, end: int) -> int:
        """The last place in (at, end) where a pretoken starts whatever stands around: a space between two others than spaces."""
        k = text.rfind(" ", at + 1, end)
        while k > at and (text[k - 1].isspace() or text[k + 1].isspace()):
            k = text.rfind(" ", at + 1, k)
        return k

    def _parts(self, text: str, at: int, end: int) -> Iterator[bytes]:
        while end - at > PIECE:
            if (cut := self._safe_cut(text, at, at + PIECE)) > at:
                yield self._plain(text[at:cut])
                at = cut
                continue
            until = at + PIECE
            for m in self.pattern.finditer(text, at, end):  # a run without such a place: pretoken by pretoken
                ids = self.stream(m[0].encode())
                while part := array("I", islice(ids, PIECE)):
                    yield part.tobytes()
                at = m.end()
                if at >= until:
                    break
        if at < end:
            yield self._plain(text[at:end])

    def pieces(self, text: str) -> Iterator[bytes]:
        """The ids of a text in order, some thousands at a time, packed as unsigned little-endian 32-bit."""
        at = 0
        for m in self.special.finditer(text) if self.special and any(s in text for s in self.specials) else ():
            yield from self._parts(text, at, m.start())
            yield np.array([self.specials[m[0]]], "<u4").tobytes()
            at = m.end()
        yield from self._parts(text, at, len(text))

    def encode(self, text: str) -> bytes:
        """All ids of a text, packed."""
        return b"".join(self.pieces(text))

    def decode(self, pieces: Iterable[list[int]]) -> Iterator[str]:
        """The text of ids that come in pieces: the state machine keeps at most an unfinished character."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in pieces:
            yield machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)))
        yield machine.decode(b"", True)


@lru_cache(2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        try:
            for b in batches:
                ids = [np.frombuffer(t.encode(x or ""), "<u4").astype(np.int32) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
        finally:
            t.forget()

    return in_small_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of every array of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            texts = ["".join(t.decode([x or []])) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return in_small_batches(tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded and decoded piece by piece; neither all its ids nor the decoded text are ever held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)

        def digested(text: str) -> tuple[int, str, str]:
            n, digest, back = 0, hashlib.sha256(), hashlib.sha256()

            def ids() -> Iterator[list[int]]:
                nonlocal n
                for piece in t.pieces(text):
                    own = np.frombuffer(piece, "<u4").tolist()
                    digest.update(((b"," if n else b"") + ",".join(map(t.names.__getitem__, own)).encode()))
                    n += len(own)
                    yield own

            for part in t.decode(ids()):
                back.update(part.encode())
            return n, digest.hexdigest(), back.hexdigest()

        try:
            for b in batches:
                n, a, d = zip(*(digested(x or "") for x in b.column(1).to_pylist()), strict=True) if b.num_rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            t.forget()

    return in_small_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
