"""Product codes of vectors, their nearest entries found by annular norm pruning.

Vectors become integers and are cut into parts; each part position has a codebook of at most 256 entries. A codebook's
entries are sorted by norm. A point's distance to the entries next to its own norm bounds how far any nearer entry's norm
can lie from the point's, binary search turns that into an interval of entries, and only these are evaluated, exactly.
Rounds of assignment and averaging run over all rows: tasks add up their own sums, Spark reduces them by entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import join_by_unique, small_batches, staged

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Points that are looked up together, near in norm, and entries that give the first bound.
TOGETHER, FIRST = 128, 16


class Annuli:
    """The entries of one codebook sorted by norm."""

    def __init__(self, entries: np.ndarray) -> None:
        square = (entries * entries).sum(1)
        self.index = np.argsort(square, kind="stable")
        self.entries, self.square = entries[self.index], square[self.index]
        self.norms = np.sqrt(self.square.astype(np.float64))
        self.most = int(np.abs(entries).max(initial=0))

    def distances(self, points: np.ndarray, square: np.ndarray, some: slice) -> np.ndarray:
        """Squared distances, exact: in doubles where all sums stay below 2 ** 53, else in integers."""
        most = max(self.most, int(np.abs(points).max(initial=0)))
        kind = np.float64 if 4 * points.shape[1] * most * most < 1 << 53 else np.int64
        return square[:, None].astype(kind) + self.square[some].astype(kind) - 2 * (points.astype(kind) @ self.entries[some].T.astype(kind))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, ties to the lower; squared distance) of each point."""
        index, distance = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        square = (points * points).sum(1)
        norms, n = np.sqrt(square.astype(np.float64)), len(self.index)
        order = np.argsort(norms, kind="stable")
        for start in range(0, len(order), TOGETHER):
            rows = order[start : start + TOGETHER]
            p, p2, pn = points[rows], square[rows], norms[rows]
            middle = int(np.searchsorted(self.norms, pn[len(rows) // 2]))
            first = max(0, min(middle - FIRST // 2, n - FIRST))
            best = np.sqrt(self.distances(p, p2, slice(first, first + FIRST)).min(1).astype(np.float64))
            slack = 1e-9 * (pn + best) + 1e-9  # for the rounding of roots; the bounds themselves are inclusive
            low = np.searchsorted(self.norms, pn - best - slack, "left")
            high = np.searchsorted(self.norms, pn + best + slack, "right")
            a, b = int(low.min()), int(high.max())
            far = self.distances(p, p2, slice(a, b))
            place = np.arange(a, b)
            inside = (place >= low[:, None]) & (place < high[:, None])
            far = np.where(inside, far, np.iinfo(np.int64).max if far.dtype == np.int64 else np.inf)
            least = far.min(1)
            index[rows] = np.where(far == least[:, None], self.index[a:b], n).min(1)
            distance[rows] = least.astype(np.int64)
        return index, distance


def integers(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v): the vectors that are kept, as integers floor(1024 * x).

    Vectors that are null or hold nulls or what is not finite go. So do those whose length isn't that of the kept vector of
    the smallest vec_id, or can't be cut into four equal parts. Components are held within a bound at which all sums of one vector still fit into a long.
    """
    sane = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fit = rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).where((F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0) & sane)
    first = fit.agg(F.min_by(F.size("embedding"), F.struct(F.col("vec_id").isNull(), "vec_id", F.size("embedding"))).alias("n")).first().n or 0
    bound = float(isqrt((1 << 60) // max(1, first)))
    whole = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x * SCALE).cast("double"), F.lit(bound)), F.lit(-bound)).cast("int"))
    return fit.where(F.size("embedding") == first).select("vec_id", "label", whole.alias("v"))


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch, (rows, parts, width)."""
    v = b.column("v")
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(v), PARTS, -1)


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: entries become the floors of their points' means; unused ones stay."""
    sent, shape = rows.sparkSession.sparkContext.broadcast(books), books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [Annuli(x) for x in sent.value]
        sums, n = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        for b in batches:
            points = _matrix(b)
            for k in range(PARTS):
                at = annuli[k].nearest(points[:, k])[0]
                np.add.at(sums[k], at, points[:, k])
                n[k] += np.bincount(at, minlength=shape[1])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    told = rows.select("v").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    reduced = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(shape[2])]).alias("sums"))
    out = books.copy()
    for r in reduced.collect():  # at most one row an entry
        out[r.part, r.entry] = np.array(r.sums, np.int64) // r.n
    return out


def trained(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (part, entry, place) of integer vectors, started from those of the smallest vec_ids (null ids last, ties by the vector)."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), PARTS, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = _moved(rows, books)
    return books


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of integer vectors: two hex digits a part, and the squared distance to the entries."""
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [Annuli(x) for x in sent.value]
        for b in batches:
            points = _matrix(b)
            found = [annuli[k].nearest(points[:, k]) for k in range(PARTS)]
            codes = np.stack([i for i, _ in found], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(sum(d for _, d in found))], names=["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compressed(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that is kept, see integers().

    rows: vec_id, label, embedding; other columns are left out. label_error: the error summed over a label's rows, null
    labels together; null if it is beyond a long. Null and repeated ids stay rows of their own. An empty table gives no rows.
    """
    small_batches(rows.sparkSession, rows=10_000, size="16m")
    whole = staged(integers(rows), "vector-integers")
    if whole.isEmpty():
        return whole.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = trained(whole, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))
    codes = staged(coded(whole, books).withColumn("key", key), "vector-codes")
    sums = codes.groupBy("key").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n"))
    both = join_by_unique(codes, sums, "key", F.struct("vec_id", "code"), "inner", counted="n")
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
