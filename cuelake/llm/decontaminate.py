"""Benchmark decontamination by pigeonhole edit matching.

An item of n letters may differ from its place in a document by k = floor(rate * n) edits. It is cut into k + 1 pieces:
edits can't touch them all, so one stands there unchanged. An automaton of all pieces finds such places in one pass
over a text; each place, widened by k, is then decided by Myers' bit-parallel distance.

Items and documents are compared in lower case with runs of white space as one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import small_batches, text_or_empty

RATE, BLOCK = 0.08, 2000


def normal(text: str) -> str:
    """Lower case, white space runs as one space."""
    return " ".join(text.lower().split())


def pieces(item: str, rate: float = RATE) -> list[tuple[int, str]]:
    """(start, piece) of the k + 1 pieces of a normalized item."""
    n = int(len(item) * rate) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any part of the text, where the first such part ends)."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, (m, 0)
    get = masks.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        pv = (mh << 1 & full) | ~(xv | ph) & full
        mv = ph & xv
        if score < best[0]:
            best = score, j
            if not score:
                break
    return best


class Matcher:
    """Finds the items of one block in texts; an item is an id and a text, so an id may have several."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE) -> None:
        self.items, self.rate = list(dict.fromkeys((i, normal(t)) for i, t in items if t and normal(t))), rate
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(self.items):
            for at, p in pieces(t, rate):
                places.setdefault(p, []).append((k, at))
        self.machine = ahocorasick.Automaton()
        for p, where in places.items():
            self.machine.add_word(p, (len(p), where))
        if places:
            self.machine.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, int]]:
        """(item, distance, end in the normalized text) of every item within its budget."""
        if not self.items:
            return []
        text = normal(text)
        spots: dict[int, list[int]] = {}
        for end, (size, where) in self.machine.iter(text):
            for i, at in where:
                spots.setdefault(i, []).append(end + 1 - size - at)
        found = []
        for place, starts in spots.items():
            i, item = self.items[place]
            k, n = int(len(item) * self.rate), len(item)
            best, upto = None, None
            for s in sorted(starts):
                if upto is not None and s <= upto:  # decided with the place before
                    continue
                upto = s + k
                a = max(0, s - k)
                d, e = myers(item, text[a : s + n + 3 * k])
                if d <= k and (best is None or d < best[0]):
                    best = d, a + e
                    if not d:
                        break
            if best:
                found.append((i, *best))
        return found


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, distance, end): each item that a document holds within the error budget.

    docs: doc_id, text; benchmark: item_id, text. Null and blank texts match nothing. The items are a query set: they
    are searched in blocks of a fixed count, one pass over the documents a block, so an automaton has a proven bound.
    Repeated documents repeat their rows. Equal items count once, each different text of an id counts alone, and items
    with a null id have a null item_id, whatever the blocks. Items below 13 letters have no edits and match inside words
    too. Empty tables give no rows; other columns are left out.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    schema = "doc_id long, item_id long, distance int, end long"

    def search(part: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = Matcher(part, rate)
            for b in batches:
                got = [(d, *f) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for f in find(t)]
                cols = list(zip(*got, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "item_id", "distance", "end"])

        return rows.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [search(part) for part in item_blocks(items, block)])


def item_blocks(items: DataFrame, block: int) -> list[list[tuple[int, str]]]:
    """The query set in blocks of a fixed count, at least one."""
    blocks: list[list[tuple[int, str]]] = [[]]
    for r in items.orderBy("item_id", "text").toLocalIterator():
        if len(blocks[-1]) == block:
            blocks.append([])
        blocks[-1].append((r[0], r[1]))
    return blocks


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """The documents that hold no item, whole rows; each row is judged by its own text, so ids may repeat or be null.

    Null and blank texts hold none and stay. Items count by their texts, whatever their ids. Repeated rows stay or go
    together. Empty tables change nothing; columns stay as they are, whatever their names.
    """
    small_batches(docs.sparkSession)
    items = benchmark.where("text is not null").select(F.lit(0).cast("long").alias("item_id"), "text").distinct()

    def keep(docs: DataFrame, part: list[tuple[int, str]]) -> DataFrame:
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = Matcher(part, rate)
            for b in batches:
                yield b.filter(pa.array([not find(t or "") for t in b.column(at).to_pylist()], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    return reduce(keep, item_blocks(items, block), docs)
