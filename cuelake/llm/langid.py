"""Language identification by rank order: out-of-place distance between n-gram profiles.

A profile lists a text's most frequent 1- to 3-grams of letters, words padded by a space mark. Every language's profile
comes from counts over all training documents. A document gets the language whose ranks are least out of place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import small_batches, text_or_empty

LETTERS = regex.compile(r"\p{L}+")
ORDERS, SIZE, UNKNOWN = 3, 300, "und"
PAD = ord("_")
FLUSH = 1 << 22


def grams(text: str) -> np.ndarray:
    """Codes of a text's n-grams, repeats included; 21 bits a letter, so codes are exact."""
    words = LETTERS.findall(text.lower())
    if not words:
        return np.empty(0, np.int64)
    c = np.frombuffer(f"_{'_'.join(words)}_".encode("utf-32-le"), np.uint32).astype(np.int64)
    two = c[:-1] << 21 | c[1:]
    three = two[:-1] << 21 | c[2:]
    return np.concatenate([c[c != PAD], two, three[c[1:-1] != PAD]])


def ranked(codes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    found, n = np.unique(codes, return_counts=True)
    return found[np.lexsort((found, -n))[:size]]


def profiles(docs: DataFrame, size: int = SIZE) -> dict[str, np.ndarray]:
    """Each language's ranked codes, from (text, lang); rows with a null in either teach nothing.

    Counts cover all rows; what reaches the driver is size codes a language.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        room = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                for at in range(0, len(g), 100_000):
                    part = g[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part), pa.array(n[at : at + 100_000])], names=["lang", "gram", "n"])
            held.clear()

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                g = grams(text)
                held.setdefault(lang, []).append(g)
                room += len(g)
                if room > FLUSH:
                    yield from flush()
                    room = 0
        yield from flush()

    rows = docs.where("text is not null and lang is not null").select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    out: dict[str, list[tuple[int, int]]] = {}
    for r in best.select("lang", "rank", "gram").collect():
        out.setdefault(r[0], []).append((r[1], r[2]))
    return {k: np.array([g for _, g in sorted(v)], np.int64) for k, v in sorted(out.items())}


class Classifier:
    """Out-of-place distance to every profile at once."""

    def __init__(self, found: dict[str, np.ndarray], size: int = SIZE) -> None:
        self.langs, self.size = list(found), size
        self.codes = np.unique(np.concatenate([*found.values(), np.empty(0, np.int64)]))
        self.ranks = np.full((len(self.codes), len(found)), -1, np.int64)
        for k, g in enumerate(found.values()):
            self.ranks[np.searchsorted(self.codes, g), k] = np.arange(len(g))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """(language, closeness): und and 0 without letters or profiles; ties go to the first name."""
        codes = grams(text or "")
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        own = ranked(codes, self.size)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        theirs = np.where((self.codes[at] == own)[:, None], self.ranks[at], -1)
        away = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(own))[:, None])).sum(0)
        best = int(away.argmin())
        return self.langs[best], 1 - float(away[best]) / (self.size * len(own))


def held_out(parts: int, of: str = "doc_id", rest: int = 0) -> Column:
    """Whether crc32 of the id as text, modulo parts, is the rest; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(of).cast("string"), F.lit("")).cast("binary")) % parts == rest


def identify(docs: DataFrame, found: dict[str, np.ndarray], size: int = SIZE) -> DataFrame:
    """(doc_id, lang_pred, score) of every row from its text alone; null and letterless texts are und with score 0.

    Repeated rows keep their rows, a null doc_id is kept, other columns are left out.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(found, size)
        for b in batches:
            got = [judge(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
