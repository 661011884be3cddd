"""Packing of documents into training sequences by order-preserving dynamic programming.

Each input partition is a block of the corpus: its documents, in order, are one stream of tokens, cut
into windows of at most 2048. A window costs its padding (none if its length is a power of two),
a fixed cost for being a sequence, and a truncation penalty by where it ends: nothing at a document's
end, little at a sentence's end, more elsewhere. With g(i) = f(i) + i the best predecessor among
the cuts of the last 2048 tokens is a sliding-window minimum, kept in a monotone queue; the windows
whose length is a power of two are tried besides. Of cuts that cost the same the earliest is taken. Nothing is
shuffled, and memory is bounded by a stretch of tokens or the longest text: the program runs over stretches,
whose last window's worth is carried into the next one, and a longer text is one stretch.

Defined cases: a null text counts as empty and is packed as the end token alone; very long texts run over
several sequences; repeated rows are packed each; an empty table gives an empty result; other columns
are ignored. Each partition ends with an incomplete sequence at worst; its tail may also be cut into powers of two.
"""

from __future__ import annotations

import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.bpe import Transducer
from corpusmill.llm.common import CACHES, in_small_batches

LENGTH, END_ID = 2048, 1
#: Costs in tokens of padding: of a cut at a sentence's end, of a cut elsewhere, of each sequence.
SENTENCE, INSIDE, SEQUENCE = 6, 48, 2
#: Tokens of a stretch; the largest gap without a possible cut.
STRETCH, GAP = 1 << 19, 256
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class LibraryEncoder(Transducer):
    """The same ids, with short stretches that were not seen before encoded by a compiled library, so a small table does."""

    table_bytes = 16 << 20

    def __init__(self, path: str):
        super().__init__(path)
        special = set(self.specials.values())
        ranks = {b: i for i, b in enumerate(self.bytes_of) if i not in special}
        self.library = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})

    def _stretch(self, text: str) -> bytes:
        if (ids := self.older.get(text)) is not None:
            return self._keep(text, ids)
        return self._keep(text, array("I", self.library.encode_ordinary(text)).tobytes())

    def sentence_ends(self) -> np.ndarray:
        """Of each id: whether its text ends a sentence or a line."""
        return np.array([b[-1:] in (b".", b"!", b"?", b"\n") for b in self.bytes_of])


_ENCODERS: dict[str, LibraryEncoder] = {}
CACHES.append(_ENCODERS)


def _encoder(path: str) -> LibraryEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def cuts(doc_ends: np.ndarray, sentence_ends: np.ndarray, total: int, last: bool, length: int = LENGTH) -> np.ndarray:
    """Ends of the windows that cost least. Unless last, they stop within the final `length` tokens."""
    where = np.unique(np.concatenate([[0], doc_ends, sentence_ends, [total]]))
    gaps, step = np.diff(where), min(GAP, max(1, length // 8))
    fill = [np.arange(where[k] + step, where[k + 1], step) for k in np.flatnonzero(gaps > step)]
    tail = [np.arange(max(0, total - length), total)] if last else []
    where = np.unique(np.concatenate([where, *fill, *tail]))
    price = np.full(len(where), INSIDE)
    price[np.isin(where, sentence_ends)] = SENTENCE
    price[np.isin(where, doc_ends)] = 0
    if last:
        price[-1] = 0
    exact: dict[int, list[int]] = {}  # predecessors at a distance of a power of two
    size = 1
    while size < length:
        at = np.searchsorted(where, where - size)
        for j in np.flatnonzero((where >= size) & (where[at] == where - size)).tolist():
            exact.setdefault(j, []).append(int(at[j]))
        size *= 2
    p, extra = where.tolist(), (price + SEQUENCE).tolist()
    f, of = [0] * len(p), [0] * len(p)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (g, position, index), g rising
    for j in range(1, len(p)):
        here = p[j]
        while queue[0][1] < here - length:
            queue.popleft()
        g, at, i = queue[0]
        best = g + length - here
        if here - at != length and j in exact:
            for k in exact[j]:
                if f[k] < best:
                    best, i = f[k], k
        best += extra[j]
        f[j], of[j] = best, i
        g = best + here
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, here, j))
    j = len(p) - 1
    if not last:
        first = int(np.searchsorted(where, max(total - length, 1)))
        j = first + int(np.argmin(f[first:]))
    out = []
    while j > 0:
        out.append(p[j])
        j = of[j]
    return np.array(out[::-1], np.int64)


def _pieces(docs: list[tuple], cut: np.ndarray, sequence: int) -> tuple[list[list], list[tuple], int]:
    """The pieces up to the last cut, the documents (or their rests) behind it, the next sequence's number.

    docs: (doc_id, tokens already cut, all tokens, packed ids that remain).
    """
    ends = np.cumsum([len(d[3]) // 4 for d in docs])
    starts = ends - [len(d[3]) // 4 for d in docs]
    whole = int(cut[-1]) if len(cut) else 0
    bounds = np.unique(np.concatenate([starts, ends, cut, [0]]))
    bounds = bounds[bounds <= whole]
    columns: list[list] = [[] for _ in range(8)]
    doc_at, cut_at = np.searchsorted(ends, bounds[:-1], "right").tolist(), np.searchsorted(cut, bounds[:-1], "right").tolist()
    begins = [0, *cut.tolist()]
    for a, b, d, c in zip(bounds[:-1].tolist(), bounds[1:].tolist(), doc_at, cut_at, strict=True):
        doc_id, done, total, ids = docs[d]
        own = ids[4 * (a - int(starts[d])) : 4 * (b - int(starts[d]))]
        for column, value in zip(columns, (doc_id, done + a - int(starts[d]), b - a, zlib.crc32(own), total, sequence + c, a - begins[c], own), strict=True):
            column.append(value)
    rest = []
    for d, doc in enumerate(docs):
        if ends[d] > whole:
            k = max(0, whole - int(starts[d]))
            rest.append((doc[0], doc[1] + k, doc[2], doc[3][4 * k :]))
    return columns, rest, sequence + len(cut)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, tokens: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        is_end, end = encoder.sentence_ends(), np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        size = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, size, sequence
            ids = np.frombuffer(b"".join(d[3] for d in held), "<u4")
            doc_ends = np.cumsum([len(d[3]) // 4 for d in held])
            columns, held, sequence = _pieces(held, cuts(doc_ends, np.flatnonzero(is_end[ids]) + 1, len(ids), last, length), sequence)
            size = sum(len(d[3]) // 4 for d in held)
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if tokens:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in columns[7]], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        try:
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids = encoder.encode(text or "") + end
                    held.append((doc_id, 0, len(ids) // 4, ids))
                    size += len(ids) // 4
                    if size >= STRETCH:
                        yield flush(False)
            if held:
                yield flush(True)
        finally:
            encoder.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_small_batches(rows).mapInArrow(run, SCHEMA + (", ids array<int>" if tokens else ""))
