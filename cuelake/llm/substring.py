"""Exact substring dedup by a sparse distributed suffix array.

A byte goes if a string of LENGTH bytes that covers it also starts elsewhere, in any document. All suffixes of a corpus are
too many to sort, so only those at anchors are. Every window of LENGTH bytes has an anchor, the 32-gram in it with the
least hash; equal windows have their anchors at equal places in them, so that what follows and what comes before their anchors
is equal. Windows in a row with one anchor make one stretch of text. Stretches whose gram stands once are new; those that are equal as
a whole repeat as a whole, and of them one goes on.

What goes on is range-partitioned by the suffixes' leading tokens, with sampled splitters. A bucket sorts the suffixes at
its anchors, and the reversed prefixes before them, by multikey quicksort on letters of 8 bytes to their ends, and takes the common
lengths of neighbours in both orders. A window that starts d bytes before its anchor repeats if some other stretch has d bytes before
and LENGTH - d bytes after the anchor in common with it. Ranges keep equal tokens together, so over a boundary neighbours
have less than a token in common, and no window repeats across it.

A gram with over MANY different stretches doesn't meet in one bucket. Its windows are dealt by eighths of the places that the
anchor can have in them, and by all bytes that the windows of an eighth have in common, which is the same problem with a longer
gram; so on, until a gram is as long as a window.

Equal texts are one text throughout, however many documents hold it; of LENGTH bytes or more, they go whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import join_by_unique, small_batches, staged, text_or_empty

LENGTH, GRAM, TOKEN = 400, 32, 8
#: Rows sampled a bucket for the splitters, and how many of these are searched at once.
SAMPLED, STEP = 64, 64
MANY, SPLIT, BUCKET_BYTES = 2048, 8, 2 << 20
_PLACE_BITS = 18
_PLACES = np.uint64((1 << _PLACE_BITS) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_VALUES = np.random.default_rng(400).integers(1, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}
PLACE = "o long, at int, lo int, hi int, lead long, token long, body binary"


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            _powers[name] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def stretches(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor place, first window, last window, anchor hash) of a text's runs of windows with one anchor."""
    out: list[tuple[np.ndarray, ...]] = []
    whole, wide, most = np.frombuffer(text, np.uint8), length - gram + 1, (1 << _PLACE_BITS) - length
    for at in range(0, len(whole) - length + 1, most):
        b = whole[at : at + most + length - 1]
        up, down = _power(len(b))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[b] * up, dtype=np.uint64)])
        h = _mixed((total[gram:] - total[:-gram]) * down[: len(b) - gram + 1])
        key = (h & ~_PLACES) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(key) // wide) * wide, np.iinfo(np.uint64).max)
        padded[: len(key)] = key
        grid = padded.reshape(-1, wide)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(b) - length + 1
        spot = (np.minimum(behind[:n], ahead[wide - 1 : wide - 1 + n]) & _PLACES).astype(np.int64)
        turn = np.flatnonzero(spot[1:] != spot[:-1]) + 1
        first = np.concatenate([[0], turn])
        last = np.concatenate([turn - 1, [n - 1]])
        m = spot[first]
        out.append((m + at, first + at, last + at, h[m].view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.empty(0, np.int64) for _ in range(4))


def body(text: bytes, at: int, lo: int, hi: int, length: int = LENGTH) -> bytes:
    """The digest of a stretch: the windows that start from hi to lo bytes before the anchor at ``at``, and where it stands in them."""
    return xxhash.xxh3_128_digest(text[at - hi : at - lo + length], hi)


# --- sorting -----------------------------------------------------------------------------------------------------


def multikey_sorted(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows of bytes sorted within their groups, and how many bytes each has in common with the row sorted before it; -1 before a group."""
    letters = rows.view(">u8")
    order = np.argsort(group, kind="stable")
    run = np.concatenate([[0], np.cumsum(group[order][1:] != group[order][:-1])])
    new = np.concatenate([[True], run[1:] != run[:-1]])
    first_of_group = new.copy()
    for depth in range(letters.shape[1]):
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))  # runs of one are done
        if not len(tied):
            break
        key = letters[order[tied], depth].astype(np.uint64)
        by = np.lexsort((key, run[tied]))
        order[tied], key = order[tied][by], key[by]
        new[tied[1:]] |= (key[1:] != key[:-1]) | (run[tied[1:]] != run[tied[:-1]])
        run = np.cumsum(new) - 1
    differ = rows[order[1:]] != rows[order[:-1]]
    common = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return order, np.where(first_of_group, -1, np.concatenate([[-1], common]))


def _padded(parts: list[bytes], width: int) -> np.ndarray:
    wide = -(-max(width, 1) // TOKEN) * TOKEN
    return np.frombuffer(b"".join([p.ljust(wide, b"\0") for p in parts]), np.uint8).reshape(len(parts), wide)


def repeated(group: np.ndarray, parts: list[bytes], lo: np.ndarray, hi: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(row, start, end) of what repeats of each stretch, as bytes from its anchor on: stretches of equal groups have equal anchors."""
    n = len(parts)
    sides = []
    for rows in (_padded([p[h:] for p, h in zip(parts, hi.tolist(), strict=True)], length), _padded([p[h - 1 :: -1] if h else b"" for p, h in zip(parts, hi.tolist(), strict=True)], int(hi.max()))):
        order, common = multikey_sorted(group, rows)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        sides.append((common, rank, np.maximum(common, np.append(common[1:], -1))[rank]))
    (after, rank_a, most_a), (before, rank_b, most_b) = sides
    low, high = np.maximum(lo, length - most_a), np.minimum(hi, most_b)
    some = np.flatnonzero(low <= high)
    rows, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for d in range(int(low[some].min()), int(high[some].max()) + 1) if len(some) else ():
        now = some[(low[some] <= d) & (d <= high[some])]
        if len(now) < 2:
            continue
        same = np.cumsum(after < length - d)[rank_a[now]] * (n + 1) + np.cumsum(before < d)[rank_b[now]]
        by = np.argsort(same)
        equal = same[by][1:] == same[by][:-1]
        hit = now[by[np.append(equal, False) | np.append(False, equal)]]
        rows.append(hit)
        places.append(np.full(len(hit), -d))
    row, place = np.concatenate(rows), np.concatenate(places)
    by = np.lexsort((place, row))
    row, place = row[by], place[by]
    cut = np.flatnonzero((row[1:] != row[:-1]) | (place[1:] - place[:-1] > length)) + 1
    starts, ends = np.concatenate([[0], cut]), np.append(cut, len(row)) - 1
    return list(zip(row[starts].tolist(), place[starts].tolist(), (place[ends] + length).tolist(), strict=True)) if len(row) else []


# --- Spark passes ------------------------------------------------------------------------------------------------


def _batch(rows: list[tuple], schema: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, schema.values(), strict=True)], names=list(schema))


def _anchors(rows: DataFrame, length: int) -> DataFrame:
    """(o, tid, copies, at, lo, hi, lead, token, body): a number for each different text, and its stretches as arrays."""
    kinds = {"at": pa.int32(), "lo": pa.int32(), "hi": pa.int32(), "lead": pa.int64(), "token": pa.int64(), "body": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in kinds]
            for text in b.column("text").to_pylist():
                raw = text.encode()
                m, first, last, lead = stretches(raw, length)
                lo, hi = m - last, m - first
                token = [int.from_bytes(raw[k : k + TOKEN], "big") - (1 << 63) for k in m.tolist()]
                told = [body(raw, *x, length) for x in zip(m.tolist(), lo.tolist(), hi.tolist(), strict=True)]
                for column, x in zip(out, (m, lo, hi, lead, token, told), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([b.column("tid"), *[pa.array(x, pa.list_(k)) for x, k in zip(out, kinds.values(), strict=True)]], names=["tid", *kinds])

    lists = rows.mapInArrow(run, "tid binary, at array<int>, lo array<int>, hi array<int>, lead array<long>, token array<long>, body array<binary>")
    held = lists.groupBy("tid").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in kinds])
    return held.withColumn("o", F.monotonically_increasing_id())


def _splitters(open_: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Where the buckets part, as (leading token, gram): even shares of a sample, so a common token is cut between its grams."""
    share = min(1.0, parts * SAMPLED / max(1, open_.count()))
    some = sorted((r[0], r[1]) for r in open_.sample(share, seed=7).select("token", "lead").collect())
    return sorted({some[len(some) * k // parts] for k in range(1, parts)}) if len(some) >= parts else []


def _bucket(splitters: list[tuple[int, int]]) -> Column:
    """How many splitters a row's (token, lead) has reached: among every STEP-th of them, then in one stretch."""
    kind, at = "array<struct<t:bigint,l:bigint>>", F.struct(F.col("token").alias("t"), F.col("lead").alias("l"))
    listed = lambda some: F.from_json(F.lit(json.dumps([{"t": t, "l": x} for t, x in some])), kind)  # noqa: E731  one literal in the plan
    reached = lambda c: F.size(F.filter(c, lambda x: x <= at))
    first = reached(listed(splitters[STEP - 1 :: STEP])) * STEP
    return first + reached(F.slice(listed(splitters), first + 1, STEP))


def _stretch_rows(held: DataFrame, hot: bool, length: int) -> DataFrame:
    """One row a spot of the texts (o, text, spots): b, lead, token, lo, hi, part."""
    kinds = {"b": pa.int64(), "lead": pa.int64(), "token": pa.int64(), "lo": pa.int32(), "hi": pa.int32(), "part": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for text, spots in zip(b.column("text").to_pylist(), b.column("spots").to_pylist(), strict=True):
                for s in spots:
                    out.append((s["b"], s["lead"], s["token"], s["lo"], s["hi"], text[s["at"] - s["hi"] : s["at"] - s["lo"] + length]))
                    if len(out) == 4000:
                        yield _batch(out, kinds)
                        out.clear()
            if out:
                yield _batch(out, kinds)

    some = held.select("text", F.filter("spots", lambda s: s.hot == F.lit(hot)).alias("spots")).where(F.size("spots") > 0)
    return some.mapInArrow(run, "b long, lead long, token long, lo int, hi int, part binary")


def _sorted_repeats(rows: DataFrame, splitters: list[tuple[int, int]], length: int) -> DataFrame:
    """(b, start, end) of what repeats, from stretches in buckets of leading tokens; a bucket is sorted in slices between grams."""
    kinds = {"b": pa.int64(), "start": pa.int32(), "end": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def settle() -> Iterator[pa.RecordBatch]:
            b, lead, lo, hi, parts = zip(*held, strict=True)
            held.clear()
            found = repeated(np.array(lead), list(parts), np.array(lo), np.array(hi), length)
            if found:
                yield _batch([(b[k], s, e) for k, s, e in found], kinds)

        for t in batches:
            for row in zip(*(t.column(c).to_pylist() for c in ("b", "lead", "lo", "hi", "part")), strict=True):
                if size > BUCKET_BYTES and row[1] != last:
                    yield from settle()
                    size = 0
                held.append(row)
                size, last = size + len(row[4]), row[1]
        if held:
            yield from settle()

    bucket = _bucket(splitters) if splitters else F.lit(0)
    ordered = rows.withColumn("bucket", bucket.cast("int")).repartitionById(len(splitters) + 1, "bucket").sortWithinPartitions("token", "lead")
    return ordered.select("b", "lead", "lo", "hi", "part").mapInArrow(run, "b long, start int, end int")


def _split(parts: DataFrame, width: int, length: int) -> DataFrame:
    """The places of stretches (b, lo, hi, part), cut by ``width`` places of the anchor; a piece's gram is what its windows have in common."""
    kinds = {"o": pa.int64(), "at": pa.int32(), "lo": pa.int32(), "hi": pa.int32(), "lead": pa.int64(), "token": pa.int64(), "body": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for o, lo, hi, part in zip(*(b.column(c).to_pylist() for c in ("b", "lo", "hi", "part")), strict=True):
                for q in range(lo // width, hi // width + 1):
                    low, high = q * width, (q + 1) * width - 1
                    gram = part[hi - low : hi - high + length]  # the anchor is at hi
                    lead = xxhash.xxh3_64_intdigest(gram, q) - (1 << 63)
                    lows, highs = max(low, lo), min(high, hi)
                    out.append((o, hi, lows, highs, lead, lead, body(part, hi, lows, highs, length)))
                if len(out) > 4000:
                    yield _batch(out, kinds)
                    out.clear()
            if out:
                yield _batch(out, kinds)

    return parts.select("b", "lo", "hi", "part").mapInArrow(run, PLACE)


def _repeats(places: DataFrame, attach: Callable[[DataFrame], DataFrame], length: int, width: int, many: int) -> tuple[DataFrame, DataFrame]:
    """Spans (o, at, start, end) that repeat, from the anchor on, and the texts that had to be read for it.

    places: stretches as in PLACE. attach: joins texts as bytes to rows (o, spots).
    """
    spark = places.sparkSession
    leads = staged(places.groupBy("lead").agg(F.count("*").alias("n")).where("n > 1"), "repeated-grams")
    near = staged(join_by_unique(places, leads, "lead", F.col("o"), "inner", counted="n").drop("n"), "repeated-places")
    bodies = near.groupBy("body").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("o", "at", "lo", "hi", "lead", "token")])
    bodies = staged(bodies.withColumn("b", F.monotonically_increasing_id()), "stretches")
    kinds = bodies.groupBy("lead").agg(F.count("*").alias("m")).where("m > 1")
    open_ = staged(join_by_unique(bodies.drop("body", "n"), staged(kinds, "open-grams"), "lead", F.col("b"), "inner", counted="m"), "open-stretches")
    spot = F.struct("b", "at", "lo", "hi", "lead", "token", (F.col("m") > many).alias("hot"))
    spots = near.select("o").distinct().join(open_.groupBy("o").agg(F.collect_list(spot).alias("spots")), "o", "left")
    held = staged(attach(spots), "held-texts")
    splitters = _splitters(open_.where(F.col("m") <= many), max(1, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = _sorted_repeats(_stretch_rows(held, False, length), splitters, length)
    if not open_.where(F.col("m") > many).isEmpty():
        parts = staged(_stretch_rows(held, True, length), "split-stretches")
        narrow = -(-width // SPLIT)
        texts = parts.select(F.col("b").alias("o"), F.col("part").alias("text"))
        more, _ = _repeats(_split(parts, narrow, length), lambda s: texts.join(s, "o"), length, narrow, many)
        found = found.unionByName(more.select(F.col("o").alias("b"), "start", "end"))
    whole = bodies.where("n > 1").select("body", "n", (-F.col("hi")).alias("start"), (length - F.col("lo")).alias("end"))
    partly = bodies.where("n = 1").select("b", "body", "n").join(found, "b").select("body", "n", "start", "end")
    spans = whole.unionByName(partly).groupBy("body").agg(F.first("n").alias("n"), F.collect_list(F.struct("start", "end")).alias("spans"))
    told = join_by_unique(near.select("o", "at", "body"), staged(spans, "spans"), "body", F.col("o"), "inner", counted="n")
    return told.select("o", "at", F.explode("spans").alias("s")).select("o", "at", "s.*"), held


def remove_repeats(docs: DataFrame, length: int = LENGTH, many: int = MANY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (null where nothing or everything went) of every row.

    A null text counts as empty and keeps its nothing. Repeated rows are copies like any others and null ids keep their
    rows. An empty table gives an empty result; other columns are left out.
    """
    spark = docs.sparkSession
    small_batches(spark, rows=500, size="16m")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ids = texts.select("doc_id", F.unhex(F.sha2("text", 256)).alias("tid"), F.octet_length("text").cast("long").alias("n_bytes"))
    rows = texts.where(F.octet_length("text") >= length).select(F.unhex(F.sha2("text", 256)).alias("tid"), "text")
    anchors = staged(_anchors(rows, length), "anchors")
    fields = ["at", "lo", "hi", "lead", "token", "body"]
    places = anchors.select("o", F.explode(F.arrays_zip(*fields)).alias("s")).select("o", "s.*")

    def attach(spots: DataFrame) -> DataFrame:
        named = anchors.select("o", "tid", "copies").join(spots, "o")
        return rows.groupBy("tid").agg(F.first("text").cast("binary").alias("text")).join(named, "tid")

    found, held = _repeats(places, attach, length, length - GRAM + 1, many)
    gone = found.groupBy("o").agg(F.collect_list(F.struct((F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"))).alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for tid, raw, spans in zip(b.column("tid").to_pylist(), b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True):
                kept, upto, n, removed, end = [], 0, 0, 0, -1
                for s, e in sorted((x["start"], x["end"]) for x in spans):
                    if s > end:
                        n += 1
                        kept.append(raw[upto:s])
                        removed += e - s
                    else:
                        removed += max(0, e - end)
                    end = max(end, e)
                    upto = end
                kept.append(raw[upto:])
                rest = b"".join(kept)
                out.append((tid, removed, n, hashlib.sha256(rest).hexdigest(), rest))
            yield _batch(out, {"tid": pa.binary(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()})

    pieces = held.where("copies = 1").select("o", "tid", "text").join(gone, "o")
    some = pieces.select("tid", "text", "gone").mapInArrow(cut, "tid binary, n_removed long, n_spans long, kept_sha256 string, kept binary")
    whole = anchors.where("copies > 1").select("tid", F.lit(-1).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"))
    out = join_by_unique(ids, some.unionByName(whole), "tid", F.col("doc_id"))
    removed = F.when(F.col("n_removed") < 0, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0)))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", F.lower(F.hex("tid"))).alias("kept_sha256"), "kept")
