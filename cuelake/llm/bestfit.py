"""Bounded-space online best-fit packing of documents into sequences of a fixed number of tokens.

One pass tokenizes every document and cuts the longer ones; a piece is known by its place and checksum alone, so ids never
move. Pieces are dealt into streams, in which they arrive in blocks, longest first, and each of which keeps a fixed number
of open bins. A bitset keyed by free space says which bins a piece fits in; the one that it fills best takes it. If none
does and all are open, the fullest closes. A block is no longer than the open bins are many, so that a block never closes its own.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import small_batches, staged, text_or_empty
from cuelake.llm.packing import WordIds

WINDOW, END, OPEN, STREAM = 2048, 0, 2048, 65_536


class OpenBins:
    """At most ``most`` open bins by free space, and a bitset of the free spaces that some bin has."""

    def __init__(self, window: int, most: int) -> None:
        self.window, self.most, self.made, self.open = window, most, 0, 0
        self.bits, self.bins = 0, defaultdict(list)

    def _take(self, free: int) -> int:
        some = self.bins[free]
        found = some.pop()
        if not some:
            self.bits ^= 1 << free
        self.open -= 1
        return found

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of the next piece: the open bin with the least space that holds it, else a new one."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            if self.open == self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, at, self.made = self.window, self.made, self.made + 1
        left = free - length
        if left:  # a full bin is closed
            self.bins[left].append(at)
            self.bits |= 1 << left
            self.open += 1
        return at, self.window - free


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row: its ids and the end id, cut every ``window`` ids."""
    small_batches(docs.sparkSession, rows=500, size="16m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = WordIds(path), np.array([end], "<u4").tobytes()
        for b in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                raw = encode(text).astype("<u4", copy=False).tobytes() + last
                for k, at in enumerate(range(0, len(raw), 4 * window)):
                    some = raw[at : at + 4 * window]
                    doc.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(some) // 4)
                    crc.append(zlib.crc32(some))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of a fixed size, the last one shorter."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= size:
            *full, rest = pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=size)
            full, held = ([*full, rest], []) if rest.num_rows == size else (full, [rest])
            n = sum(x.num_rows for x in held)
            yield from full
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def packed(found: DataFrame, window: int = WINDOW, most_open: int = OPEN, stream: int = STREAM) -> DataFrame:
    """found with sequence_id and offset: about ``stream`` rows are packed together, in memory that one block and the open bins take."""
    streams = max(1, -(-found.count() // stream))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, base = OpenBins(window, most_open), TaskContext.get().partitionId() << 32
        for b in _blocks(batches, most_open):
            b = b.take(pc.sort_indices(b.column("length"), sort_keys=[("", "descending")]))
            put = np.array([bins.put(n) for n in b.column("length").to_pylist()], np.int64).reshape(-1, 2)
            yield b.append_column("sequence_id", pa.array(put[:, 0] + base)).append_column("offset", pa.array(put[:, 1]))

    dealt = found.repartition(streams)
    return dealt.mapInArrow(run, found.schema.add("sequence_id", "long").add("offset", "long"))


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, most_open: int = OPEN, stream: int = STREAM) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    path: the tokenizer file. Null and empty texts hold the end id alone. Repeated rows and null ids are packed row by
    row. An empty table gives no pieces; other columns are left out. At most ``most_open`` sequences a stream end less than best filled.
    """
    return packed(staged(pieces(docs, path, window, end), "bestfit-pieces"), window, most_open, stream)
