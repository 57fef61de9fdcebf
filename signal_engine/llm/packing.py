"""Harmonic packing of documents into sequences of a fixed capacity.

Lengths fall into reciprocal-capacity classes: class k holds what is longer than capacity / (k + 1) tokens and at
most capacity / k, and each of its bins takes exactly k documents. Every worker fills its own bins, one open bin
a class, in the order of its documents; nothing but the number of sequences of each worker is combined. A document
is cut only where that is due: full sequences are cut off one that exceeds the capacity; and the bin that was
closed last gets the head of the next document for the room it has left. So there is at most one such bin, a
document has at most two pieces besides its full sequences, and bins have no padding. At a worker's end its open
bins, at most one a class, are joined into full sequences, and the tail, less than one sequence, closes in
sequences whose lengths are powers of two, which need no padding.

Defined results: null or empty text is a document of the end id alone; repeated or null keys are packed as
separate documents; an empty table gives an empty result; other columns are ignored. The capacity is a power of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signal_engine.llm.common import as_arrow_string, CACHE_WORDS, Scratch, SLICE_BYTES, slices, tidy, word_tokenizer

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, seq long, offset long"


class Bins:
    """The bins of one worker. A piece is (doc, start, ids, doc tokens); emit gets (piece, sequence, offset)."""

    def __init__(self, capacity: int, emit: Callable):
        self.capacity, self.emit, self.sequences = capacity, emit, 0
        self.open: dict[int, list] = {}  # class: pieces, fewer than the class takes
        self.last: list = []  # the pieces of the closed bin that has room left
        self.room = 0

    def close(self, pieces: list) -> None:
        at = 0
        for piece in pieces:
            self.emit(piece, self.sequences, at)
            at += len(piece[2])
        self.sequences += 1

    def add(self, doc, ids: np.ndarray) -> None:
        """Place a whole document."""
        start, total = 0, len(ids)
        while total - start >= self.capacity:
            self.close([(doc, start, ids[start : start + self.capacity], total)])
            start += self.capacity
        if self.room and start < total:
            head = ids[start : start + self.room]
            self.last.append((doc, start, head, total))
            self.room -= len(head)
            start += len(head)
            if not self.room:
                self.close(self.last)
                self.last = []
        if start < total:
            k = self.capacity // (total - start)
            pieces = self.open.setdefault(k, [])
            pieces.append((doc, start, ids[start:].copy(), total))
            if len(pieces) == k:
                del self.open[k]
                self.room = self.capacity - sum(len(p[2]) for p in pieces)
                if self.room:  # a bin with room was filled just before, so none is waiting
                    self.last = pieces
                else:
                    self.close(pieces)

    def finish(self) -> None:
        """Close what is open: full sequences, then one for each set bit of the rest, largest first."""
        left = [*self.last, *(p for k in sorted(self.open) for p in self.open[k])]
        rest = sum(len(p[2]) for p in left)
        sizes = [self.capacity] * (rest // self.capacity) + [1 << b for b in range(self.capacity.bit_length() - 1, -1, -1) if rest % self.capacity >> b & 1]
        pieces, need = [], sizes.pop(0) if sizes else 0
        for doc, start, ids, total in left:
            while len(ids):
                part, ids = ids[:need], ids[need:]
                pieces.append((doc, start, part, total))
                start, need = start + len(part), need - len(part)
                if not need:
                    self.close(pieces)
                    pieces, need = [], sizes.pop(0) if sizes else 0
        self.open, self.last, self.room = {}, [], 0


def pack_documents(docs: DataFrame, scratch: Scratch, tokenizer_file: str, end_id: int, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Smaller caches and slices
    take less memory and more time."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def pieces(batches):
        from pyspark import TaskContext

        tok, part = word_tokenizer(tokenizer_file, cache_words), TaskContext.get().partitionId()
        rows: list[tuple] = []
        bins = Bins(capacity, lambda p, seq, at: rows.append((p[0], p[1], len(p[2]), zlib.crc32(p[2]), p[3], part, seq, at)))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "seq", "offset"])

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), as_arrow_string(batch.column(1))
            for i, j in slices(texts, slice_bytes):
                ids, counts = tok.encode(texts[i:j])
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                ends = np.cumsum(counts + 1).tolist()
                for key, a, b in zip(keys[i:j], [0, *ends[:-1]], ends, strict=True):
                    bins.add(key, ids[a:b])
                if rows:
                    yield batch_of()
        bins.finish()
        if rows:
            yield batch_of()

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    placed = scratch.write(rows.mapInArrow(tidy(pieces), PIECES), "pieces")
    # one row for each worker
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_worker = placed.groupBy("part").agg((F.max("seq") + 1).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return placed.join(per_worker, "part").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("seq")).alias("sequence_id"), "offset")
