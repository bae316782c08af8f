"""SimHash near-duplicates: pigeonring candidates, full Hamming check, components.

Fingerprints of 64 bits lie on a ring of 8 segments of 8 bits. If two differ in at most 2 bits, then from
some segment on every chain of l segments holds at most 2*l/8 of the differences: none in the first three,
one in the first seven. So a row's 8 runs of three segments are its keys, equal keys make candidates, the
chain of seven prunes them, and the full distance decides.

A key shared by over BUCKET fingerprints doesn't list its pairs. Its fingerprints are linked through their
one-bit neighbours instead: two that differ in at most 2 bits have one in common, all that
have one in common differ in at most 2 bits, and at most 65 can. That is as exact, and linear.

The stage that keeps one document of each class links five-word shingle sets alike to 0.8. Fingerprints of those shingles go
through the same ring first, and whole sets decide their links. At 0.8, though, 64 SimHash bits differ in about 10, so no selective
key of bits finds all. A second ring finds the rest, with letters in place of bits: 64 least hashes of the
shingles, of which such sets share about 51.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import connected_components, join_by_unique, small_batches, staged, text_or_empty

SEED, SHINGLE, MOST_BITS, SEGMENTS, BUCKET = 42, 3, 2, 8, 64
BLOCK = 1 << 16
#: The deduplicating stage: words of a shingle, similarity, and sketches of 16 segments of 4 letters of 16 bits.
STAGE_SHINGLE, ALIKE, PARTS, PART = 5, 0.8, 16, 4
LETTERS = PARTS * PART
#: Letters in which sketches agree before their texts are compared; of pairs just at ALIKE 99 in 100 do.
LIKELY = 44
#: Sketches of one key that meet in a task.
MEET = 2048
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, LETTERS, np.uint64) * np.uint64(2) + np.uint64(1)
_word_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text; 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + shingle - 1]
        runs = zip(*(part[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [part]
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(r), SEED) for r in runs), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; a null text counts as empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((simhash(t, shingle) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fp long")


def turned(x: Column, segment: Column | int) -> Column:
    """x rotated so that the segment comes first."""
    by = F.lit(segment) * 8 if isinstance(segment, int) else segment * 8
    return F.expr("0L").bitwiseOR(F.call_function("shiftrightunsigned", x, by.cast("int"))).bitwiseOR(F.call_function("shiftleft", x, F.pmod(64 - by, F.lit(64)).cast("int")))


def links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect exactly what Hamming distances of at most 2 connect.

    nodes: (fp, node), one row a fingerprint.
    """
    ring = nodes.select("fp", "node", F.posexplode(F.array(*[turned(F.col("fp"), i).bitwiseAND(F.lit(0xFFFFFF)) for i in range(SEGMENTS)])).alias("segment", "key"))
    ring = ring.select((F.col("segment") * F.lit(1 << 24) + F.col("key")).alias("key"), "segment", "fp", "node")
    sizes = staged(ring.groupBy("key").count().where("count > 1"), "ring-sizes")
    shared = staged(ring.join(sizes, "key"), "ring-shared")
    few = shared.where(F.col("count") <= bucket).groupBy("key").agg(F.first("segment").alias("segment"), F.collect_list(F.struct("fp", "node")).alias("all"))
    pairs = few.select("segment", "all", F.explode("all").alias("x")).select("segment", "x", F.explode("all").alias("y")).where("x.node < y.node")
    differ = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    chain = F.bit_count(turned(differ, F.col("segment")).bitwiseAND(F.lit((1 << 56) - 1)))
    near = pairs.where((chain <= 1) & (F.bit_count(differ) <= MOST_BITS)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    many = shared.where(F.col("count") > bucket).select("fp", "node").distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    common = many.select("node", F.explode(F.concat(F.array("fp"), flips)).alias("v")).groupBy("v").agg(F.collect_list("node").alias("all")).where(F.size("all") > 1)
    hub = common.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")
    return near.unionByName(hub).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id): every row's class of near-duplicates.

    Texts that are null or empty have fingerprint 0 and form a class like any other. Repeated rows keep
    their rows. A null doc_id
    takes the class of the documents with its fingerprint, null if there are none.
    An empty table gives an empty result; other columns are left out.
    """
    fps = staged(fingerprints(docs, shingle), "simhash")
    nodes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"), "simhash-nodes")
    comps = connected_components(links(nodes, bucket))
    named = staged(nodes.join(comps, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "simhash-classes")
    out = join_by_unique(fps, named, "fp", F.col("doc_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- the deduplicating stage: five-word shingles alike to ALIKE -----------------------------------------------------


def sketch(text: str) -> bytes:
    """LETTERS letters of 16 bits: for each factor, bits of the least hash of a text's five-word shingles.

    Two sketches agree in about the share of their letters that is the shingle sets' similarity. Texts without words have one sketch.
    """
    words = text.encode().lower().split()
    if not words:
        return b"\xff" * (2 * LETTERS)
    h = np.fromiter(map(_word_hash, words), np.uint64, len(words))
    n = max(1, len(h) - STAGE_SHINGLE + 1)
    runs = np.zeros(n, np.uint64)
    for i in range(min(STAGE_SHINGLE, len(h))):
        runs = (runs ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        runs ^= runs >> np.uint64(29)
    least = np.full(LETTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, n, 512):
        np.minimum(least, (runs[at : at + 512, None] * FACTORS).min(0), out=least)
    return (least >> np.uint64(16)).astype("<u2").tobytes()


def agreement(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """In how many letters the sketches of two columns agree, row by row."""
    a, b = (np.frombuffer(b"".join(c), "<u2").reshape(-1, LETTERS) for c in (x, y))
    return (a == b).sum(1)


def text_nodes(docs: DataFrame) -> DataFrame:
    """(node, digest, doc_id, sketch, fp) of every different text: a number, its digest, the least doc_id that holds it, the fingerprint of its five-word shingles."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            fps = np.fromiter((simhash(t, STAGE_SHINGLE) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array([sketch(t) for t in texts], pa.binary()), pa.array(fps.view(np.int64))], names=["doc_id", "digest", "sketch", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"), text_or_empty().alias("text"))
    told = rows.mapInArrow(run, "doc_id long, digest binary, sketch binary, fp long")
    nodes = told.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"), F.first("fp").alias("fp"))
    return staged(nodes.withColumn("node", F.monotonically_increasing_id()), "text-nodes")  # numbers hold once they are written


def text_digest() -> Column:
    """The digest that names a text; a null text counts as empty."""
    return F.unhex(F.md5(text_or_empty()))


def fingerprint_pairs(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): what the pigeonring links by fingerprints, through one node of each, and that node beside all others of its fingerprint."""
    heads = staged(nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("n")), "stage-fingerprints")
    same = join_by_unique(nodes.select("fp", F.col("node").alias("b")), heads, "fp", F.col("b"), "inner", counted="n").where("head <> b").select(F.col("head").alias("a"), "b")
    return links(heads.select("fp", F.col("head").alias("node")), bucket).unionByName(same)


def ring_keys(nodes: DataFrame) -> DataFrame:
    """(key, segment, node): each segment of a sketch as a key."""
    keys = [F.struct(F.lit(i).alias("segment"), F.xxhash64(F.substring("sketch", 2 * PART * i + 1, 2 * PART), F.lit(i)).alias("key")) for i in range(PARTS)]
    return nodes.select("node", F.explode(F.array(*keys)).alias("k")).select("k.key", "k.segment", "node")


def shared_keys(ring: DataFrame, label: str) -> DataFrame:
    """The ring's rows (key, segment, node, n) at keys that n > 1 nodes have."""
    sizes = staged(ring.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), f"{label}-sizes")
    return staged(join_by_unique(ring, sizes, "key", F.col("node"), "inner", counted="n"), f"{label}-shared")


def hub_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): each node b beside the hub a of its keys, the node that shares its keys with the most others.

    An original shares all its keys with its edited copies, a copy only those that its edits spared.
    """
    known = shared.groupBy("node").agg(F.sum("n").alias("known"))
    hubs = shared.join(known, "node").groupBy("key").agg(F.max(F.struct("known", "node")).alias("best"), F.count("*").alias("n"))
    hubs = staged(hubs.select("key", "n", F.col("best.node").alias("a")), "ring-hubs")
    return join_by_unique(shared.select("key", F.col("node").alias("b")), hubs, "key", F.col("b"), "inner", counted="n").where("a <> b").select("a", "b")


def alike(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """The edges (a, b) whose texts' five-word shingles are alike to ALIKE, by the whole sets.

    texts: (node, text), one row a node.
    """
    small_batches(edges.sparkSession, rows=200, size="16m")
    pairs = staged(join_by_unique(edges, texts.toDF("a", "text_a"), "a", F.col("b"), "inner"), "alike-pairs")
    pairs = join_by_unique(pairs, texts.toDF("b", "text_b"), "b", F.col("a"), "inner")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            told = zip(t.column("text_a").to_pylist(), t.column("text_b").to_pylist(), strict=True)
            sets = ((shingle_set(x), shingle_set(y)) for x, y in told)
            yield t.select(["a", "b"]).filter(pa.array([len(x & y) >= ALIKE * len(x | y) for x, y in sets], pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(decide, "a long, b long")


def shingle_set(text: str) -> frozenset[bytes]:
    """The five-word shingles of a text; of a shorter one all its words."""
    words = text.encode().lower().split()
    return frozenset(b" ".join(words[i : i + STAGE_SHINGLE]) for i in range(max(1, len(words) - STAGE_SHINGLE + 1)))


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, agree) of the pairs (a, b) whose sketches agree in LIKELY letters or more."""
    pairs, told = staged(pairs.distinct(), "ring-pairs"), nodes.select("node", "sketch")
    both = join_by_unique(pairs, told.toDF("a", "x"), "a", F.col("b"), "inner")
    both = join_by_unique(both, told.toDF("b", "y"), "b", F.col("a"), "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            agree = agreement(t.column("x").to_pylist(), t.column("y").to_pylist())
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), pa.array(agree.astype(np.int32))], names=["a", "b", "agree"]).filter(pa.array(agree >= LIKELY))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, agree int")


def _crossing(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """The shared rows with their component so far, at keys that still hold more than one."""
    told = shared.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    told = staged(told, "ring-components")
    open_ = staged(told.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m")).where("low < high").select("key", "m"), "ring-open")
    return staged(join_by_unique(told, open_, "key", F.col("node"), "inner", counted="m"), "ring-crossing")


def _pairs_of(rows: DataFrame) -> DataFrame:
    """(a, b) of different components at the keys of rows (key, node, comp), a few rows a key."""
    all_ = rows.groupBy("key").agg(F.collect_list(F.struct("node", "comp")).alias("all"))
    pairs = all_.select("all", F.explode("all").alias("x")).select("x", F.explode("all").alias("y")).where("x.node < y.node and x.comp <> y.comp")
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def shingle_hashes(text: str) -> np.ndarray:
    """The sorted 64-bit hashes of a text's different five-word shingles."""
    return np.unique(np.fromiter(map(_word_hash, shingle_set(text)), np.uint64))


def _links_in_blocks(rows: DataFrame, nodes: DataFrame, texts: DataFrame, block: int) -> DataFrame:
    """Links (a, b) between components at keys of any size: blocks of rows meet in pairs inside a task, which gets each text once.

    A pair must hold a chain: an equal segment, and at most one other letter in the next. It is looked at at the first such
    segment alone, so once, however many keys it shares. Of sketches that agree in LIKELY letters, hashes of the shingles
    are counted, and where they reach ALIKE the whole sets decide. What a task has linked so far is not compared again, so
    no more links come out than components went in.
    """
    def run(key: tuple, t: pa.Table) -> pa.Table:
        _, i, j = (k.as_py() for k in key)
        node, comp, mine = (t.column(c).to_numpy() for c in ("node", "comp", "mine"))
        segment, text, found = t.column("segment")[0].as_py(), t.column("text"), []
        x = np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u2").reshape(-1, LETTERS)
        comp = np.unique(comp, return_inverse=True)[1]
        sets: dict[int, np.ndarray] = {}

        def hashes(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingle_hashes(text[k].as_py())
            return sets[k]

        right = np.flatnonzero(mine == j)
        for k in np.flatnonzero(mine == i).tolist():
            near = right[(comp[right] != comp[k]) & ((node[right] > node[k]) | (i != j))]
            near = near[(x[near] == x[k]).sum(1) >= LIKELY]
            same = (x[near] == x[k]).reshape(-1, PARTS, PART).sum(2)
            chain = (same == PART) & (np.roll(same, -1, axis=1) >= PART - 1)
            for o in near[chain[:, segment] & (chain.argmax(1) == segment)].tolist():
                if comp[o] == comp[k]:
                    continue
                p, q = hashes(k), hashes(o)
                p, q = (p, q) if len(p) <= len(q) else (q, p)
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                if both >= ALIKE * (len(p) + len(q) - both):
                    one, other = shingle_set(text[k].as_py()), shingle_set(text[o].as_py())
                    if len(one & other) >= ALIKE * len(one | other):
                        found.append((int(node[k]), int(node[o])))
                        comp[comp == comp[o]] = comp[k]
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": a, "b": b})

    many = rows.withColumn("blocks", F.ceil(F.col("m") / block).cast("int")).join(nodes.select("node", "sketch"), "node").join(texts, "node")
    many = many.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select("key", "segment", "node", "comp", "sketch", "text", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    return many.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def similar_texts(docs: DataFrame, nodes: DataFrame, bucket: int = BUCKET, block: int = MEET) -> DataFrame:
    """(node, component) of the nodes of ``text_nodes`` whose texts' five-word shingles are alike to ALIKE, through any chain of texts.

    Fingerprints within MOST_BITS bits make candidates by the pigeonring of ``links``. They don't tell all pairs at ALIKE, so sketches
    make the others. A sketch is a ring of PARTS segments of PART letters. Of two that differ in under a letter a segment, some segment is
    equal and the chain from it on stays in its budget; at ALIKE an equal segment is nearly certain (all but one pair in five thousand).
    First each text is compared to those that its fingerprint links, and to the most alike of the hubs of its keys. Then whatever else shares a key and isn't
    linked so far is compared too: all pairs at keys of up to ``bucket`` texts; more meet in blocks, which hold each text
    once, prune pairs by chains of two segments, and give links only.
    """
    shared = shared_keys(ring_keys(nodes), "ring")
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest")).alias("row"), text_or_empty().alias("text"))
    named = nodes.select(F.struct("doc_id", "digest").alias("row"), "node")

    def texts_of(found: DataFrame, label: str) -> DataFrame:
        ends = named.join(found.distinct(), "node", "left_semi")
        return staged(rows.join(ends, "row").select("node", "text").dropDuplicates(["node"]), f"{label}-texts")

    def decided(edges: DataFrame, label: str) -> DataFrame:
        edges = staged(edges.select("a", "b"), f"{label}-likely")
        return staged(alike(edges, texts_of(edges.select(F.explode(F.array("a", "b")).alias("node")), label)), f"{label}-edges")

    hubs = likely(hub_pairs(shared), nodes)
    best = hubs.groupBy("b").agg(F.max(F.struct("agree", "a")).alias("best"))
    by_bits = fingerprint_pairs(nodes, bucket).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    by_letters = best.select(F.least("best.a", "b").alias("a"), F.greatest("best.a", "b").alias("b"))
    first = decided(by_bits.unionByName(by_letters).distinct(), "hub")
    comps = staged(connected_components(first), "hub-components")
    open_ = _crossing(shared.drop("n"), comps)
    found = _pairs_of(open_.where(F.col("m") <= bucket))
    hot = open_.where(F.col("m") > bucket)
    links = first.unionByName(decided(likely(found, nodes).select("a", "b"), "rest"))
    if not hot.isEmpty():
        links = links.unionByName(staged(_links_in_blocks(hot, nodes, texts_of(hot.select("node"), "hot"), block), "block-edges"))
    return connected_components(links)


def keep_one(docs: DataFrame, bucket: int = BUCKET, block: int = MEET) -> DataFrame:
    """The documents without near-duplicates: of each class the row with the least doc_id stays, of its repeats one.

    Classes are texts whose whole five-word shingle sets are alike to ALIKE, through any chain of texts (``similar_texts``). Null texts count as
    empty; texts without words are alike. Null ids come after all others, so a row with one stays only if no row of its
    class has an id. Rows that share an id but not a text are judged each by its text. Columns are unchanged, whatever their names; an empty table
    stays empty.
    """
    nodes = text_nodes(docs)
    comps = similar_texts(docs, nodes, bucket, block)
    named = nodes.join(comps, "node", "left").select(F.coalesce("component", "node").alias("component"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest").alias("row"))
    chosen = named.groupBy("component").agg(F.min("row").alias("row")).select(F.struct("row.doc_id", "row.digest").alias("row"))
    own = F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("all")
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest")).alias("row"), own)
    kept = rows.join(chosen, "row", "left_semi").dropDuplicates(["row"])
    return kept.select(*[F.col(f"all.c{k}").alias(c) for k, c in enumerate(docs.columns)])
