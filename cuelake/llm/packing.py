"""Lexical retrieval packing: documents fill windows of a fixed number of tokens with their BM25 neighbours.

One pass tokenizes every document and keeps, in place of its ids, the checksums of their prefixes at every GRAIN ids and
its term counts. Document frequencies come from all documents. The documents are sorted by the terms of the highest
weight that they share with others, best term first, and cut by sampled splitters into shards of about SHARD documents, so that neighbours
come to lie in one shard and a common key is split by its next terms. Each shard builds an inverted index and packs: a seed document opens a window, all its
terms query the index, and unused neighbours fill the window, best first. The document that reaches over the
end is cut at a grain and its rest is the next seed. What no neighbour fills, the next unused documents fill.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import small_batches, staged, text_or_empty

WINDOW, END, GRAIN, SHARD = 4096, 2, 32, 4096
K1, B, KEY_TERMS = 1.2, 0.75, 16
#: Rows sampled a shard for the splitters, which only say where shards end: every row is dealt by them.
PER_SHARD = 64
CACHE = 1_000_000
#: Texts with these go to the tokenizer whole: code points that compose or lower in context, and odd white space.
BEYOND = re.compile("[\x85\xa0\u0130\u0149\u01f0\u0250-\U0010ffff]")
CONTROLS = re.compile("[\x1c-\x1f]")


@lru_cache(maxsize=2)
def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _alphabet() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it prints, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(others)}


class _Words(dict):
    """Packed ids of words; a word that isn't here yet is encoded and kept."""

    pieces = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    letters = _alphabet()

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer = _load(path)
        self.merge = self.tokenizer.model.tokenize

    def __missing__(self, word: str) -> bytes:
        if "'" in word or "<|" in word:
            ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        elif (low := word.lower()) != word:
            ids = self[low]
        elif word[-1] in ".,;:!?" and word[:-1].isalpha():
            ids = self[word[:-1]] + self[word[-1]]
        elif word.isalpha() or len(parts := self.pieces.findall(word)) == 1:
            ids = array("I", [t.id for t in self.merge(word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))]).tobytes()
        else:
            ids = b"".join([self[p] for p in parts])
        self[word] = ids
        return ids


class WordIds:
    """The ids of whole texts by a tokenizer whose pieces never cross white space; words are looked up once.

    A word's pieces are its letter runs, its digits and its other runs, each merged by the tokenizer's model.
    Texts beyond the plain range, and words with apostrophes or special tokens, go to the tokenizer itself.
    """

    _known: dict[str, _Words] = {}

    def __init__(self, path: str) -> None:
        if path not in WordIds._known:
            WordIds._known[path] = _Words(path)
        self.known = WordIds._known[path]

    def __call__(self, text: str) -> np.ndarray:
        if not text.isascii() and BEYOND.search(text) or CONTROLS.search(text):
            return np.array(self.known.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(self.known) > CACHE:
            self.known.clear()
        return np.frombuffer(b"".join(map(self.known.__getitem__, text.split())), np.uint32)


# --- checksums of pieces -----------------------------------------------------------------------------------------

_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC-32 polynomial, in reflected bits."""
    out = 0
    while b:
        if b & 0x80000000:
            out ^= a
        b = (b << 1) & 0xFFFFFFFF
        a = (a >> 1) ^ (_POLY if a & 1 else 0)
    return out


@lru_cache(maxsize=1 << 14)
def _shift(n_bytes: int) -> int:
    """x to the power of 8 * n_bytes."""
    out, base, n = 0x80000000, 0x00800000, n_bytes
    while n:
        if n & 1:
            out = _times(out, base)
        base, n = _times(base, base), n >> 1
    return out


def piece_crc(prefix_start: int, prefix_end: int, n_bytes: int) -> int:
    """The CRC-32 of the bytes between two prefixes, from the prefixes' own."""
    return prefix_end ^ _times(prefix_start, _shift(n_bytes)) if prefix_start else prefix_end


# --- tokenizing --------------------------------------------------------------------------------------------------


def tokenized(docs: DataFrame, path: str, grain: int = GRAIN) -> DataFrame:
    """(doc_id, row, tokens, crcs, terms, counts) of every row: ids counted with the end id, prefix CRC-32s at 0, grain, 2 * grain, ... and the end, distinct ids and how often each."""
    small_batches(docs.sparkSession, rows=500, size="16m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, row = WordIds(path), TaskContext.get().partitionId() << 32
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text in b.column("text").to_pylist():
                ids = np.append(encode(text), np.uint32(END)).astype("<u4")
                raw, crc, crcs = ids.tobytes(), 0, [0]
                for at in range(0, len(raw), 4 * grain):
                    crc = zlib.crc32(raw[at : at + 4 * grain], crc)
                    crcs.append(crc)
                terms, n = np.unique(ids[:-1], return_counts=True)
                for column, v in zip(out, (row, len(ids), np.array(crcs, "<u4").tobytes(), terms.astype("<u4").tobytes(), n.astype("<u4").tobytes()), strict=True):
                    column.append(v)
                row += 1
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(v, k) for v, k in zip(out, kinds, strict=True)]], names=["doc_id", "row", "tokens", "crcs", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, tokens long, crcs binary, terms binary, counts binary")


def frequencies(rows: DataFrame) -> tuple[np.ndarray, int, float]:
    """(documents of each term, documents, mean length) over all rows; the vocabulary bounds what is returned."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(0, np.int64)
        for b in batches:
            got = np.bincount(np.frombuffer(b"".join(b.column("terms").to_pylist()), "<u4"))
            if len(got) > len(n):
                n = np.concatenate([n, np.zeros(len(got) - len(n), np.int64)])
            n[: len(got)] += got
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["term", "n"])

    found = rows.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(found.term.max()) + 1 if len(found) else 1, np.int64)
    out[found.term] = found.n
    docs, mean = rows.agg(F.count("*"), F.avg("tokens")).first()
    return out, docs, float(mean or 1.0)


# --- packing -----------------------------------------------------------------------------------------------------


def weigh(tf: np.ndarray, idf: np.ndarray, length: np.ndarray | int, mean: float) -> np.ndarray:
    """BM25 weights of terms in documents of some length."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def lexical_key(terms: np.ndarray, counts: np.ndarray, length: int, idf: np.ndarray, mean: float) -> bytes:
    """What documents are dealt by: the terms of the highest weight, best first; terms without weight are left out."""
    weight = weigh(counts.astype(np.float32), idf[terms], length, mean)
    best = np.argsort(-weight, kind="stable")[:KEY_TERMS]
    return terms[best[weight[best] > 0]].astype(">u4").tobytes()


class Index:
    """An inverted index with BM25 weights over the documents of one shard.

    Terms in an eighth of the documents or more keep their weights as rows of a table, the others as postings; a score is the sum of both.
    """

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray, idf: np.ndarray, mean: float) -> None:
        doc = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        term = np.concatenate([*terms, np.empty(0, np.uint32)]).astype(np.int64)
        tf = np.concatenate([*counts, np.empty(0, np.uint32)]).astype(np.float32)
        weight = weigh(tf, idf[term], lengths[doc], mean).astype(np.float32)
        some = weight > 0
        doc, term, weight = doc[some], term[some], weight[some]
        order = np.argsort(term, kind="stable")
        self.names, starts = np.unique(term[order], return_index=True)
        self.bounds = np.append(starts, len(term))
        self.docs, self.weights = doc[order], weight[order]
        self.size = len(terms)
        common = np.flatnonzero(np.diff(self.bounds) * 8 >= self.size)
        self.row = np.full(len(self.names), -1)
        self.row[common] = np.arange(len(common))
        self.table = np.zeros((len(common), self.size), np.float32)
        for k, r in zip(common, range(len(common)), strict=True):
            run = slice(self.bounds[k], self.bounds[k + 1])
            self.table[r, self.docs[run]] = self.weights[run]
        self.starts = np.searchsorted(doc, np.arange(self.size + 1))
        self.queries = np.searchsorted(self.names, term)
        self.held = np.arange(self.size)

    def keep(self, unused: np.ndarray) -> None:
        """Take used documents out of the postings and the table; they can still be asked with."""
        stays = unused[self.held]
        some = stays[self.docs]
        self.bounds = np.append(0, np.cumsum(some))[self.bounds]
        self.docs, self.weights = (np.cumsum(stays) - 1)[self.docs[some]], self.weights[some]
        self.table, self.held, self.size = self.table.compress(stays, axis=1), self.held[stays], int(stays.sum())

    def scores(self, doc: int) -> np.ndarray:
        """The BM25 score of every document held for one document's terms."""
        at = self.queries[self.starts[doc] : self.starts[doc + 1]]
        rows = self.row[at]
        score = self.table[rows[rows >= 0]].sum(0)
        runs = [slice(self.bounds[k], self.bounds[k + 1]) for k in at[rows < 0]]
        if runs:
            score = score + np.bincount(np.concatenate([self.docs[r] for r in runs]), np.concatenate([self.weights[r] for r in runs]), self.size)
        return score

    def neighbours(self, doc: int, first: int = 64, unused: np.ndarray | None = None) -> Iterator[int]:
        """Unused documents that share a term, best first, ties by place; those beyond the first are put in order once they are asked for.

        Once a quarter of the documents held are used, the index is made smaller.
        """
        if unused is not None and 4 * np.count_nonzero(unused[self.held]) < 3 * self.size:
            self.keep(unused)
        score, held = self.scores(doc), self.held
        hit = np.flatnonzero(score > 0 if unused is None else (score > 0) & unused[held])
        least = np.partition(score[hit], -first)[-first] if len(hit) > first else 0
        for some in (hit[score[hit] >= least], hit[score[hit] < least]):
            yield from held[some[np.argsort(-score[some], kind="stable")]].tolist()


def fill(lengths: np.ndarray, neighbours, window: int = WINDOW, grain: int = GRAIN) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold every token once.

    neighbours: from a document, with unused telling which have tokens left, to those to take, best first. Seeds go in order; a document's rest after a cut seeds the next window before any other.
    """
    n = len(lengths)
    done, out, sequence, free = np.zeros(n, np.int64), [], 0, 0
    left = [k for k in range(n) if lengths[k]]
    rest: int | None = None
    while True:
        while free < len(left) and done[left[free]] == lengths[left[free]]:
            free += 1
        if rest is None and free == len(left):
            return out
        seed = rest if rest is not None else left[free]
        rest, at = None, 0

        def put(k: int, at: int, sequence: int) -> int:
            size = min(int(lengths[k] - done[k]), window - at)
            if size < lengths[k] - done[k]:
                size -= (done[k] + size) % grain
            if size > 0:
                out.append((k, int(done[k]), int(size), sequence, at))
                done[k] += size
            return at + max(int(size), 0)

        at = put(seed, at, sequence)
        more = iter(neighbours(seed, unused=done < lengths)) if at < window and done[seed] == lengths[seed] else iter(())
        spare = iter(range(free, len(left)))
        if done[seed] < lengths[seed]:
            rest = seed
        while rest is None and window - at > 0:
            k = next(more, None)
            if k is None:
                j = next(spare, None)
                if j is None:
                    break
                k = left[j]
            if done[k] == lengths[k]:
                continue
            at = put(int(k), at, sequence)
            if done[k] < lengths[k]:
                rest = int(k) if done[k] else None
                if not done[k]:
                    break
        sequence += 1


def pack(docs: DataFrame, path: str, window: int = WINDOW, grain: int = GRAIN, shard: int = SHARD) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    path: the tokenizer file. Null and empty texts hold the end id alone. Repeated rows and null ids are packed row by
    row. An empty table gives no pieces; other columns are left out. Sequences are numbered within shards, a shard's
    number above; the last of a shard may be short.
    """
    spark = docs.sparkSession
    rows = staged(tokenized(docs, path, grain), "packing-tokens")
    df, total, mean = frequencies(rows)
    # a term of one document has no weight, as it leads to no other
    idf = spark.sparkContext.broadcast(np.where(df > 1, np.log(1 + (total - df + 0.5) / (df + 0.5)), 0).astype(np.float32))
    shards = max(1, round(total / shard))

    def keyed(cuts: list[tuple[bytes, int]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = list(zip(*(b.column(c).to_pylist() for c in ("terms", "counts", "tokens", "row")), strict=True))
            keys = [lexical_key(np.frombuffer(t, "<u4"), np.frombuffer(c, "<u4"), n, idf.value, mean) for t, c, n, _ in told]
            dealt = [bisect_right(cuts, (key, x[3])) for key, x in zip(keys, told, strict=True)]
            yield b.append_column("key", pa.array(keys, pa.binary())).append_column("shard", pa.array(dealt, pa.int64()))

    narrow = rows.select("row", "tokens", "terms", "counts").sample(min(1.0, PER_SHARD / shard), seed=1)
    told = narrow.mapInArrow(lambda x: keyed([], x), "row long, tokens long, terms binary, counts binary, key binary, shard long").select("key", "row").collect()
    order = sorted((bytes(r["key"]), r["row"]) for r in told)
    cuts = spark.sparkContext.broadcast([order[len(order) * k // shards] for k in range(1, shards)] if order else [])

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["key", "row"], ignore_index=True)
        terms = [np.frombuffer(x, "<u4") for x in part.terms]
        counts = [np.frombuffer(x, "<u4") for x in part.counts]
        lengths = part.tokens.to_numpy(np.int64)
        index = Index(terms, counts, lengths, idf.value, mean)
        found = pd.DataFrame(fill(lengths, index.neighbours, window, grain), columns=["k", "start", "length", "sequence", "offset"])
        crcs = [np.frombuffer(x, "<u4") for x in part.crcs]
        ends = found.start + found.length
        sums = [piece_crc(int(crcs[k][a // grain]), int(crcs[k][-1 if b == lengths[k] else b // grain]), 4 * (b - a)) for k, a, b in zip(found.k, found.start, ends, strict=True)]
        return pd.DataFrame({"doc_id": part.doc_id.to_numpy()[found.k] if not part.doc_id.isna().any() else part.doc_id.astype("Int64").take(found.k).array, "start": found.start, "length": found.length, "ids_crc32": np.array(sums, np.int64), "doc_tokens": lengths[found.k], "sequence_id": (int(part["shard"].iloc[0]) << 32) + found.sequence, "offset": found.offset})

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    dealt = rows.mapInArrow(lambda x: keyed(cuts.value, x), "doc_id long, row long, tokens long, crcs binary, terms binary, counts binary, key binary, shard long")
    return dealt.groupBy("shard").applyInPandas(packed, schema)
