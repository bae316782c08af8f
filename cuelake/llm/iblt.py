"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions only.

A text's paragraphs are its lines, long lines cut after every second sentence, and after 160 letters without one. Their 64-bit digests go into a sketch of 3
tables of 8 cells; a cell holds how many digests fell into it, their exclusive or, and that of the digests' check
hashes. One version's digests are taken out of the other's sketch: what they share cancels. A cell left with one digest gives it
up, which frees others, until nothing is left (the difference is known) or no cell is pure. Then the sketch is retried
2 to 16 times as large, by the sets' sizes, as that many sketches of the digests by another hash; only those that fail grow again. So
the work is linear in the paragraphs that differ and no array outgrows its document's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import staged, text_or_empty

TABLES, CELLS, ROUNDS, LEVELS = 3, 8, 8, 32
PART = 12  # digests of both sets that a part of a retry holds, about: 85 of 100 sketches give up so many that differ
PARAGRAPH = r"(?:[^.!?\n]{0,160}+[.!?]++){1,2}|[^.!?\n]{1,160}+"
BLOCK_BITS, GROUP_BITS, FEW = 5, 12, 10_000
LEAST = -(1 << 63)


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.trim(p))
    return F.array_distinct(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.xxhash64(p)))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _inside(key: Column, i: int, level: int) -> Column:
    """Whether a digest falls into cell i of all tables' cells; every level reads other bits."""
    low = i // CELLS * 3 + 9 * (level % 6)
    return key.bitwiseAND(F.lit(CELLS - 1 << low)) == F.lit(i % CELLS << low)


def _cell(n: Column, k: Column, h: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), k.cast("long").alias("k"), h.cast("long").alias("h"))


def sketch(keys: Column, level: int = 0, without: Column | None = None) -> Column:
    """The cells of a set of digests, with those of another taken out again.

    Each cell's test is spelled out with its own bits, since functions of arrays are not compiled.
    """
    def cell(i: int) -> Column:
        mine = lambda c: F.filter(c, lambda k: _inside(k, i, level))
        fold = lambda c, start, one: F.aggregate(mine(c), start, lambda x, k: _cell(x.n + one, x.k.bitwiseXOR(k), x.h.bitwiseXOR(F.xxhash64(k))))
        held = fold(keys, _cell(F.lit(0), F.lit(0), F.lit(0)), 1)
        return held if without is None else fold(without, held, -1)

    return F.array(*[cell(i) for i in range(TABLES * CELLS)])


def peel(cells: Column, level: int = 0) -> Column:
    """struct(cells, found): what is left, and the recovered (digest k, n = 1 if only left has it, -1 if only right)."""
    pure = lambda c: (F.abs(c.n) == 1) & (F.xxhash64(c.k) == c.h)

    def freed(cells: Column, out: Column) -> Column:
        def less(i: int) -> Column:
            mine = F.filter(out, lambda p: _inside(p.k, i, level))
            return F.aggregate(mine, cells[i], lambda x, p: _cell(x.n - p.n, x.k.bitwiseXOR(p.k), x.h.bitwiseXOR(F.xxhash64(p.k))))

        return F.array(*[less(i) for i in range(TABLES * CELLS)])

    def step(state: Column, _: Column) -> Column:
        out = F.array_distinct(F.transform(F.filter(state.cells, pure), lambda c: F.struct(c.k.alias("k"), c.n.alias("n"))))
        end = F.struct(state.cells.alias("cells"), state.found.alias("found"), F.lit(True).alias("stuck"))
        more = lambda p: F.struct(freed(state.cells, p).alias("cells"), F.concat(state.found, p).alias("found"), F.lit(False).alias("stuck"))
        return F.when(state.stuck, state).otherwise(_let(out, lambda p: F.when(F.size(p) == 0, end).otherwise(more(p))))

    start = F.struct(cells.alias("cells"), F.array().cast("array<struct<k:bigint,n:int>>").alias("found"), F.lit(False).alias("stuck"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def written(cells: Column) -> Column:
    """A sketch as text."""
    pad = lambda c, n: F.lpad(F.hex(c), n, "0")
    return F.lower(F.array_join(F.transform(cells, lambda c: F.concat(pad(c.n.cast("long"), 8), pad(c.k, 16), pad(c.h, 16))), ""))


def differences(pairs: DataFrame, keys: list[str], recovered: bool = False) -> DataFrame:
    """How many digests differ between two sets, for rows of (keys..., a, b): keys..., differ.

    With recovered, one row for each digest instead: keys..., digest, only_left.
    """
    solved, pending = [], pairs
    for level in range(LEVELS):
        # each cell gives up one digest at most, so a larger difference of sizes can't be peeled
        hopeless = F.abs(F.size("a") - F.size("b")) > TABLES * CELLS
        got = pending.select(*keys, "a", "b", F.when(~hopeless, peel(sketch(F.col("a"), level, F.col("b")), level)).alias("p"))
        clean = F.col("p").isNotNull() & ~F.exists("p.cells", lambda c: (c.n != 0) | (c.k != 0) | (c.h != 0))
        got = got.select(*keys, clean.alias("ok"), "a", "b", "p.found")
        hide = lambda c: F.when(~F.col("ok"), F.col(c)).alias(c)
        found = F.when(F.col("ok"), F.col("found")) if recovered else F.when(F.col("ok"), F.size("found").cast("long"))
        got = staged(got.select(*keys, "ok", hide("a"), hide("b"), found.alias("found")), f"iblt-{level}")
        solved.append(got.where("ok").select(*keys, "found"))
        failed = got.where("not ok")
        if failed.isEmpty():
            break
        both = F.size("a") + F.size("b")
        many = F.when(both > 8 * PART, 16).when(both > 4 * PART, 8).when(both > 2 * PART, 4).otherwise(2)
        own = lambda c, part: F.filter(c, lambda k: F.xxhash64(k, F.lit(level + 1)).bitwiseAND(F.col("last")) == part).alias(c)  # noqa: B023, E731
        parts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda part: F.struct(own("a", part), own("b", part)))
        pending = failed.withColumn("last", (many - 1).cast("long")).select(*keys, F.explode(parts).alias("p")).select(*keys, "p.a", "p.b")
    all_ = reduce(DataFrame.unionByName, solved)
    if recovered:
        return all_.select(*keys, F.explode("found").alias("f")).select(*keys, F.col("f.k").alias("digest"), (F.col("f.n") == 1).alias("only_left"))
    return all_.groupBy(*keys).agg(F.sum("found").alias("differ"))


def _successors(keys: DataFrame) -> DataFrame:
    """(key, next) of distinct keys, the least after the largest; beyond FEW keys by groups of 2**GROUP_BITS values."""
    keys = staged(keys.distinct(), "keys")
    if keys.count() <= FEW:
        every = Window.orderBy("key")
        return keys.select("key", F.coalesce(F.lead("key").over(every), F.min("key").over(every)).alias("next"))
    own = keys.withColumn("group", F.shiftright("key", GROUP_BITS))
    later = _successors(own.select(F.col("group").alias("key"))).withColumnRenamed("key", "group")
    first = own.groupBy(F.col("group").alias("next")).agg(F.min("key").alias("first"))
    later = later.join(first, "next").select("group", "first")
    lead = F.lead("key").over(Window.partitionBy("group").orderBy("key"))
    return staged(own.withColumn("lead", lead).join(later, "group").select("key", F.coalesce("lead", "first").alias("next")), "successors")


def with_next_text(docs: DataFrame) -> DataFrame:
    """(doc_id, place, text, next_text): every text beside that of the next document by id, the first after the last.

    Null ids come first and rows of one id follow each other by text. Ids are laid out in blocks of 32; a block's texts
    meet in one shuffle, and only each block's first text travels once more, to the block before it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("block", F.shiftright(F.coalesce("doc_id", F.lit(LEAST)), BLOCK_BITS))
    order = Window.partitionBy("block").orderBy("doc_id", "text")
    placed = rows.select("*", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("lead"))
    before = _successors(rows.select(F.col("block").alias("key"))).select(F.col("key").alias("before"), F.col("next").alias("block"))
    heads = placed.where("place = 1").select("block", "text").join(before, "block").select(F.col("before").alias("block"), F.col("text").alias("head"))
    return placed.join(heads, "block").select("doc_id", F.struct("block", "place").alias("place"), "text", F.coalesce("lead", "head").alias("next_text"))


def likeness(left: Column, right: Column, differ: Column) -> Column:
    """Shared over all digests, from the sizes of two sets and of their difference; 1 for two empty sets."""
    both = left + right
    return F.when(both == 0, F.lit(1.0)).otherwise((both - differ) / (both + differ))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document. A
    null text counts as empty, and texts without paragraphs are alike. Repeated rows and null ids keep their rows; an
    only row is its own next document. An empty table gives an empty result; other columns are left out.
    """
    both = with_next_text(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = both.select("doc_id", "place", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "next_text")
    rows = staged(rows.select("doc_id", "place", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *[digests(F.col(c)).alias(c) for c in ("text", "edited", "next_text")]), "digests")
    pairs = rows.select("place", F.explode(F.array(*[F.struct(F.lit(c).alias("other"), F.col("text").alias("a"), F.col(c).alias("b")) for c in ("edited", "next_text")])).alias("p")).select("place", "p.*")
    differ = differences(pairs, ["place", "other"]).groupBy("place").agg(*[F.sum(F.when(F.col("other") == c, F.col("differ"))).alias(f"d_{c}") for c in ("edited", "next_text")])
    near = lambda c, name: likeness(F.size("text"), F.size(c), F.col(f"d_{c}")).alias(name)
    out = rows.join(differ, "place")
    return out.select("doc_id", "n_chars", "edited_sha256", written(sketch(F.col("text"))).alias("fingerprint"), written(sketch(F.col("edited"))).alias("edited_fingerprint"), near("edited", "near_edited"), near("next_text", "near_next"))
