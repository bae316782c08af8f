"""Importance resampling towards a target corpus by hashed n-gram features, over bucket-partitioned inverted postings.

One pass over the documents makes, for each block of documents, postings (bucket, document, count). They are shuffled by
ranges of buckets and meet there with the counts of both corpora, pre-aggregated a bucket; the gains of a range's buckets
are computed where its postings lie, and each block's contributions come out as one vector a range. These are summed by
document. Ranges hold all documents, so they are salted by block: no task grows with the corpus, only their number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import small_batches, staged, text_or_empty
from cuelake.llm.packing import _shift, _times
from cuelake.operators.scan import placed

BUCKETS, RUN, RANGES = 10_000, 3, 50
SHARE, LEAST_WORDS, SEED = 5, 20, 42
#: Letters of a text and words of a block that are taken at once, and words whose checksums a worker keeps.
STRETCH, AT_ONCE, CACHE = 1 << 22, 1 << 20, 1_000_000
#: Bytes of the words whose checksums have tables at hand.
SHORT = 64
#: ASCII capitals become small; what is no digit, letter or byte of a longer code point becomes a space.
_PLAIN = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


@lru_cache(maxsize=4096)
def _table(n_bytes: int) -> np.ndarray:
    """What a CRC-32 becomes when n_bytes zero bytes follow it, by each of its four bytes."""
    images = [_times(1 << k, _shift(n_bytes)) for k in range(32)]
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for b in range(256):
            if b:
                low = b & -b
                out[k, b] = out[k, b ^ low] ^ np.uint32(images[8 * k + low.bit_length() - 1])
    return out


@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    """The tables of the lengths that most words have, one after another."""
    return np.stack([_table(n) for n in range(SHORT)]).ravel()


def joined_crc(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32s of concatenations, from the parts' own and the second parts' lengths in bytes."""
    out, tables = second.copy(), _tables()
    base = np.minimum(lengths, SHORT - 1) * 1024
    for k in range(4):
        out ^= tables[base + k * 256 + (first >> np.uint32(8 * k) & np.uint32(255))]
    for i in np.flatnonzero(lengths >= SHORT):
        table = _table(int(lengths[i]))
        out[i] = second[i] ^ np.bitwise_xor.reduce([table[k, int(first[i]) >> 8 * k & 255] for k in range(4)])
    return out


class _Words(dict):
    """Checksum and length of words in one number; a word that isn't here yet is added."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = zlib.crc32(word) | len(word) << 32
        return out


def _words(text: bytes, known: _Words) -> np.ndarray:
    """The words of a UTF-8 text as _Words has them; a stretch of bounded length is split at once."""
    plain, out, start = text.translate(_PLAIN), [np.zeros(0, np.int64)], 0
    while start < len(plain):
        end = start + STRETCH
        if end < len(plain):
            end = plain.rfind(b" ", start, end) + 1 or plain.find(b" ", end) + 1 or len(plain)
        some = plain[start:end].split()
        if len(known) > CACHE:
            known.clear()
        out.append(np.fromiter(map(known.__getitem__, some), np.int64, len(some)))
        start = end
    return np.concatenate(out)


def features(texts: list[bytes], buckets: int = BUCKETS, known: _Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, sorted bucket * texts + place of each run of 1 to 3 consecutive words, repeats included)."""
    known = _Words() if known is None else known
    words = [_words(t, known) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    told, doc = np.concatenate([*words, np.zeros(0, np.int64)]), np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(told)) - np.repeat(np.cumsum(n) - n, n)
    kind = np.int32 if buckets * len(texts) < 1 << 31 else np.int64
    out, space = [np.zeros(0, kind)], np.uint32(zlib.crc32(b" "))
    for start in range(0, len(told), AT_ONCE):
        lo = max(0, start + 1 - RUN)  # runs that end here may begin before
        crcs, lengths = (told[lo : start + AT_ONCE] & 0xFFFFFFFF).astype(np.uint32), told[lo : start + AT_ONCE] >> 32
        spaced, ends = joined_crc(np.full(len(crcs), space), crcs, lengths), crcs  # spaced: the word after its space
        for k in range(RUN):
            if k:
                ends = np.concatenate([ends[:1], joined_crc(ends[:-1], spaced[1:], lengths[1:] + 1)])  # ends[i]: of the k + 1 words up to i
            here = np.flatnonzero(place[lo : start + AT_ONCE] >= k)
            here = here[here >= start - lo]
            out.append((ends[here] % np.uint32(buckets)).astype(kind) * kind(len(texts)) + doc[lo + here].astype(kind))
    return n, np.sort(np.concatenate(out))


def _packed(values: np.ndarray) -> bytes:
    """Numbers from 0 on as bytes: one byte each, those of 255 and more again as four or eight at the end."""
    wide = values[values >= 255]
    return np.int64(len(values)).tobytes() + np.minimum(values, 255).astype(np.uint8).tobytes() + wide.astype("<i8").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    """The numbers that _packed wrote."""
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    out = np.frombuffer(raw, np.uint8, n, 8).astype(np.int64)
    out[out == 255] = np.frombuffer(raw[8 + n :], "<i8")
    return out


def postings(texts: DataFrame, buckets: int = BUCKETS, ranges: int = RANGES, name: str = "text") -> DataFrame:
    """Blocks of rows as (block, range, size, keys, counts, totals, doc_ids, words).

    A block's row of range -1 has its documents' ids and words. The others have the postings of a range of buckets: keys
    (place of the bucket in the range times the block's size, plus the document's place; packed steps from one to the next), how often each, and the
    totals of the range's buckets.
    """
    small_batches(texts.sparkSession, rows=2000, size="16m")
    width = -(-buckets // ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, known = TaskContext.get().partitionId() << 32, _Words()
        for b in batches:
            size = b.num_rows
            n, found = features(b.column("text").to_pylist(), buckets, known)
            first = np.flatnonzero(np.diff(found, prepend=-1))
            keys, counts = found[first].astype(np.int64), np.diff(np.append(first, len(found)))
            bounds = np.searchsorted(keys, np.arange(ranges + 1) * width * size)
            totals = np.bincount(keys // size, counts, ranges * width).astype(np.int64).reshape(ranges, width)
            some = [k for k in range(ranges) if bounds[k] < bounds[k + 1]]
            parts = [slice(bounds[k], bounds[k + 1]) for k in some]
            nothing = [None] * len(some)
            yield pa.RecordBatch.from_arrays([
                pa.array([block] * (1 + len(some)), pa.int64()), pa.array([-1, *some], pa.int32()), pa.array([size] * (1 + len(some)), pa.int32()),
                pa.array([None, *[_packed(np.diff(keys[p], prepend=k * width * size)) for k, p in zip(some, parts, strict=True)]], pa.binary()),
                pa.array([None, *[_packed(counts[p]) for p in parts]], pa.binary()),
                pa.array([None, *[totals[k] for k in some]], pa.list_(pa.int64())),
                pa.array([b.column("doc_id").to_pylist(), *nothing], pa.list_(pa.int64())), pa.array([n, *nothing], pa.list_(pa.int64())),
            ], names=["block", "range", "size", "keys", "counts", "totals", "doc_ids", "words"])
            block += 1

    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(name).cast("binary").alias("text"))
    return rows.mapInArrow(run, "block long, range int, size int, keys binary, counts binary, totals array<long>, doc_ids array<long>, words array<long>")


def _runs(words: Column) -> Column:
    """How many runs of 1 to 3 consecutive words there are."""
    return sum((F.greatest(words - k, F.lit(0).cast("long")) for k in range(1, RUN)), words)


def _per_bucket(found: DataFrame, name: str) -> DataFrame:
    """(range, place, name): the features of each bucket, summed in tasks first."""
    rows = found.where("range >= 0").select("range", F.posexplode("totals").alias("place", "n"))
    return rows.groupBy("range", "place").agg(F.sum("n").alias(name))


def _features_of(found: DataFrame) -> int:
    """How many features all texts have."""
    rows = found.where("range < 0").select(F.explode("words").alias("n"))
    return rows.agg(F.sum(_runs(F.col("n")))).first()[0] or 0


def weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, ranges: int = RANGES) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of docs: the sum of its features' gains towards the target's texts.

    A null text has no words. Null ids and repeated rows stay rows of their own. An empty target has no features: gains
    then come from the counts of docs alone. An empty table of docs gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    own = staged(postings(docs, buckets, ranges), "resample-postings")
    aim = staged(postings(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, ranges), "resample-target")
    all_own, all_aim, width = _features_of(own), _features_of(aim), -(-buckets // ranges)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, -(-4 * parts // ranges))

    counts = _per_bucket(own, "s").join(_per_bucket(aim, "t"), ["range", "place"], "left").na.fill(0, ["t"])
    place = F.struct("place", "s", "t")
    of_range = counts.groupBy("range").agg(F.array_sort(F.collect_list(place)).alias("both")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = own.where("range >= 0").select("block", "range", "size", "keys", "counts", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"))
    met = dealt.join(of_range.hint("merge"), ["range", "salt"])  # postings move to their buckets' counts, never the counts to all
    gain = F.transform("both", lambda x: F.floor(1000 * F.log((x.t + 1.0) * (all_own + buckets) / ((x.s + 1.0) * (all_aim + buckets)))).cast("long"))
    at = met.select("block", "size", "keys", "counts", F.transform("both", lambda x: x.place).alias("places"), gain.alias("gains"))

    def contributed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for size, keys, n, places, gains in zip(*(b.column(c).to_pylist() for c in ("size", "keys", "counts", "places", "gains")), strict=True):
                by_place = np.zeros(width, np.int64)
                by_place[places] = gains
                bucket, doc = np.divmod(np.cumsum(_unpacked(keys)), size)
                order = np.argsort(doc, kind="stable")
                ends = np.searchsorted(doc[order], np.arange(size + 1))
                upto = np.append(0, np.cumsum((by_place[bucket] * _unpacked(n))[order]))
                out.append((upto[ends[1:]] - upto[ends[:-1]]).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(out, pa.binary())], names=["block", "sums"])

    def reduced(part: pd.DataFrame) -> pd.DataFrame:
        of = part[part["words"].notna()].iloc[0]
        weight = np.zeros(len(of["words"]), np.int64)
        for x in part["sums"].dropna():
            weight += np.frombuffer(x, "<i8")
        ids = [None if i is None or i != i else int(i) for i in of["doc_ids"]]
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_words": of["words"], "weight": weight})

    sums = at.mapInArrow(contributed, "block long, sums binary")
    both = sums.unionByName(own.where("range < 0").select("block", "doc_ids", "words"), allowMissingColumns=True)
    told = both.groupBy("block").applyInPandas(reduced, "doc_id long, n_words long, weight long")
    return told.select("doc_id", "n_words", _runs(F.col("n_words")).alias("n_features"), "weight")


def drawn(weighed: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): Gumbel noise of the id is added to the weight, the highest share per cent get ranks.

    Rows below least_words are never drawn. Ties go to the smaller id, a null id first. Ranks come from a segmented scan, so no task orders all rows.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    rows = weighed.withColumn("score", F.col("weight") + noise).withColumn("enough", F.col("n_words") >= least_words).withColumn("down", -F.col("score"))
    rows = staged(rows, "resample-scores")
    most = rows.where("enough").count() * share // 100
    rank = placed(rows, ["enough"], ["down", "doc_id"], "rank").withColumn("rank", F.when(F.col("enough") & (F.col("rank") < most), F.col("rank") + 1))
    return rank.select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Every row of docs with its weight towards the target's texts, its noisy score, and its rank if it is drawn."""
    return drawn(weights(docs, target))
