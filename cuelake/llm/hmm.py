"""Hidden Markov language model over word classes, trained by Baum-Welch on all training documents.

Every frequent word is a class of its own, the others share classes by their endings. The hidden states emit classes; a
class emits its words by their corpus counts, so that P(word | state) = P(class | state) * P(word | class) sums to one
and the model stays of a fixed size whatever the vocabulary. Word counts come from the whole corpus; words outside the
frequent list, whose table grows with the corpus, are looked up by a join.

Each Baum-Welch round is one pass: partitions add up the expected counts of their whole documents, the sums are grouped
by class, and the driver divides them. Early rounds, in which the states part, take every eighth document; the later ones take all. Scoring runs the scaled forward recursion over whole documents.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import small_batches, staged, text_or_empty

STATES, ROUNDS = 8, 6
#: Frequent words that tasks hold in memory, those of them with a class of their own, and classes by ending.
FREQUENT, OWN, ENDINGS, ENDING_BYTES = 150_000, 8192, 1024, 3
#: Rounds over one training document in EARLY, then over all until a round gains under SETTLED of the log likelihood, ROUNDS at most.
EARLY, EARLY_ROUNDS, SETTLED = 8, 12, 0.001
#: Tokens between kept forward states, and tokens that lie side by side.
STRETCH, HELD = 128, 2_000_000
ADD, FLUSH = 0.1, 400_000
CLASSES = 1 + OWN + ENDINGS


def ending(word: bytes) -> int:
    """The shared class of a word."""
    return 1 + OWN + zlib.crc32(word[-ENDING_BYTES:]) % ENDINGS


def words(text: str) -> list[bytes]:
    """The words between ASCII white space, A-Z lowered."""
    return text.encode().lower().split()


@dataclass
class Chain:
    """Start, transition and class probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # class by state


def first_guess(class_counts: np.ndarray, states: int = STATES) -> Chain:
    """States that stay, each with the corpus' class frequencies, unsettled a little."""
    rng = np.random.default_rng(7)
    emit = (class_counts + 0.5)[:, None] * (0.5 + rng.random((len(class_counts), states)))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Chain(np.full(states, 1 / states), move, emit / emit.sum(0))


def log_likelihood(sequences: list[np.ndarray], chain: Chain, most: int = 512) -> np.ndarray:
    """Natural log probability of each whole sequence by the scaled forward recursion, many side by side."""
    out = np.zeros(len(sequences))
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    for at in range(0, len(order), most):
        part = order[at : at + most]
        sizes = np.array([len(sequences[k]) for k in part])
        live = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0] if len(sizes) else 0), side="right")
        alpha, ll = None, np.zeros(len(part))
        for low in range(0, len(live), 256):  # classes are laid side by side a stretch at a time
            high = min(low + 256, len(live))
            grid = np.zeros((high - low, int(live[low])), np.int64)
            for b in range(grid.shape[1]):
                s = sequences[part[b]][low:high]
                grid[: len(s), b] = s
            for t in range(low, high):
                n = int(live[t])
                e = chain.emit[grid[t - low, :n]]
                alpha = e * (chain.start if alpha is None else alpha[:n] @ chain.move)
                c = alpha.sum(1)
                alpha /= c[:, None]
                ll[:n] += np.log(c)
        out[part] = ll
    return out


class Expected:
    """Expected counts of starts, moves and classes under a chain, and the log likelihood they come with."""

    def __init__(self, chain: Chain) -> None:
        k = len(chain.start)
        self.chain, self.start, self.move, self.emit, self.log = chain, np.zeros(k), np.zeros((k, k)), np.zeros((len(chain.emit), k)), 0.0

    def add(self, sequences: list[np.ndarray], most: int = 1024) -> None:
        """Forward and backward over whole sequences, many side by side."""
        whole = sorted((s for s in sequences if len(s)), key=len, reverse=True)
        for at in range(0, len(whole), most):
            self._part(whole[at : at + most])

    def _part(self, part: list[np.ndarray]) -> None:
        """Forward keeps the state at every STRETCH tokens only; backward goes forward again from there, a stretch at a time."""
        start, move, emit = self.chain.start, self.chain.move, self.chain.emit
        sizes = np.array([len(s) for s in part])
        live = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")

        def classes(low: int) -> np.ndarray:
            grid = np.zeros((min(low + STRETCH, len(live)) - low, int(live[low])), np.int64)
            for b in range(grid.shape[1]):
                s = part[b][low : low + STRETCH]
                grid[: len(s), b] = s
            return grid

        def forward(low: int, grid: np.ndarray, before: np.ndarray | None) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
            alphas, scales, told = [], [], []
            for t, row in enumerate(grid):
                n = int(live[low + t])
                e = emit[row[:n]]
                a = e * (start if before is None else before[:n] @ move)
                c = a.sum(1)
                before = a / c[:, None]
                alphas.append(before)
                scales.append(c)
                told.append(e)
            return alphas, scales, told

        lows, ends = range(0, len(live), STRETCH), [None]
        for low in lows:
            alphas, scales, _ = forward(low, classes(low), ends[-1])
            ends.append(alphas[-1])
            self.log += sum(float(np.log(c).sum()) for c in scales)
        beta, moved = np.ones((len(part), len(start))), np.zeros_like(move)
        for k in range(len(lows) - 1, -1, -1):
            low, grid = lows[k], classes(lows[k])
            alphas, scales, told = forward(low, grid, ends[k])
            gammas: list[np.ndarray] = []
            for t in range(len(grid) - 1, -1, -1):
                n = int(live[low + t])
                gammas.append(alphas[t] * beta[:n])
                before = alphas[t - 1] if t else ends[k]
                if before is not None:
                    back = told[t] * beta[:n] / scales[t][:, None]
                    moved += before[:n].T @ back
                    beta[:n] = back @ move.T
            seen, g = np.concatenate([row[: int(live[low + t])] for t, row in enumerate(grid)]), np.concatenate(gammas[::-1])
            for j in range(len(start)):
                self.emit[:, j] += np.bincount(seen, g[:, j], len(self.emit))
        self.start += gammas[-1].sum(0)
        self.move += moved * move

    def chain_of(self) -> Chain:
        """The chain that these counts make, with a little of each event added."""
        even = lambda x: (x + 0.01) / (x + 0.01).sum(-1, keepdims=True)
        return Chain(even(self.start), even(self.move), even(self.emit.T).T.copy())


@dataclass
class Vocabulary:
    """Frequent words with their classes and log probabilities, and what the shared classes hold."""

    place: dict[bytes, int]
    classes: np.ndarray
    base: np.ndarray
    within: np.ndarray
    shared: np.ndarray  # log10 of each class's words and types, for its members
    log_all: float
    total: int
    types: int
    ends: int
    class_counts: np.ndarray


def count_words(train: DataFrame) -> DataFrame:
    """(word, n) over all training texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            w, c = list(n.keys()), list(n.values())
            for a in range(0, len(w), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(w[a : a + 50_000], pa.binary()), pa.array(c[a : a + 50_000], pa.int64())], names=["word", "n"])
            n.clear()

        for b in batches:
            for t in b.column("text").to_pylist():
                n.update(words(t))
            if len(n) > FLUSH:
                yield from flush()
        yield from flush()

    return train.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """What tasks need to know of the counts; its size is bounded by FREQUENT and ENDINGS."""
    share = F.crc32(F.expr(f"substring(word, -{ENDING_BYTES}, {ENDING_BYTES})")) % ENDINGS
    by_class = counts.groupBy(share.cast("int").alias("k")).agg(F.sum("n"), F.count("*")).collect()
    # the frequent words are those above a count that a histogram of counts gives, so no task sends more than its share
    step = F.floor(F.log("n") * 50).cast("int")
    room, cut = FREQUENT, None
    for k, c in sorted(((r[0], r[1]) for r in counts.groupBy(step.alias("k")).count().collect()), reverse=True):
        if c > room:
            break
        room, cut = room - c, k
    top = [] if cut is None else sorted(((bytes(r[0]), r[1]) for r in counts.where(step >= cut).collect()), key=lambda x: (-x[1], x[0]))
    total, types = sum(r[1] for r in by_class) + ends, sum(r[2] for r in by_class) + bool(ends)
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, c, d in by_class:
        n[1 + OWN + k], v[1 + OWN + k] = c, d
    for w, c in top[:OWN]:
        n[ending(w)] -= c
        v[ending(w)] -= 1
    shared = np.log10(n + ADD * (v + 1))
    classes = np.array([1 + i if i < OWN else ending(w) for i, (w, _) in enumerate(top)], np.int64)
    c = np.array([c for _, c in top], float)
    log_all = math.log10(total + ADD * (types + 1))
    within = np.where(np.arange(len(top)) < OWN, 0.0, np.log10(c + ADD) - shared[classes] if len(top) else 0.0)
    return Vocabulary({w: i for i, (w, _) in enumerate(top)}, classes, np.log10(c + ADD) - log_all, within, shared, log_all, total, types, ends, np.concatenate([[ends], [x for _, x in top[:OWN]], np.zeros(OWN - len(top[:OWN])), n[1 + OWN :]]))


def encoded(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Each document as classes, with what its frequent words add to the scores, and its other words."""
    held = rows.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, row = held.value, TaskContext.get().partitionId() << 32
        find, end_base = v.place.get, math.log10(v.ends + ADD) - v.log_all
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in b.column("text").to_pylist():
                w = words(text)
                at = np.fromiter((find(x, -1) for x in w), np.int64, len(w))
                known = at >= 0
                hot = at[known]
                rare = [w[k] for k in np.flatnonzero(~known)]
                classes = np.zeros(len(w) + 1, "<u2")  # the last is the end, class 0
                classes[:-1][known] = v.classes[hot]
                shared = np.fromiter(map(ending, rare), np.int64, len(rare))
                classes[:-1][~known] = shared
                base = v.base[hot].sum() - len(rare) * v.log_all + end_base
                within = v.within[hot].sum() - v.shared[shared].sum()
                for column, x in zip(out, (row, len(w) + 1, len(hot) + (v.ends > 0), base, within, classes.tobytes(), rare), strict=True):
                    column.append(x)
                row += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]], names=["doc_id", "held_out", "row", "n_tokens", "known", "base", "within", "classes", "rare"])

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, row long, n_tokens long, known long, base double, within double, classes binary, rare array<binary>")


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in column.to_pylist()]


def baum_welch_round(train: DataFrame, chain: Chain) -> tuple[Chain, float]:
    """One round over all training sequences, and the log likelihood before it: counts by partition, summed by class."""
    held, k = train.sparkSession.sparkContext.broadcast(chain), len(chain.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, some, size = Expected(held.value), [], 0
        for b in batches:
            some += _sequences(b.column("classes"))
            size += sum(map(len, some[-b.num_rows :]))
            if size > HELD:
                e.add(some)
                some, size = [], 0
        e.add(some)
        rows = np.vstack([e.start, e.move, e.emit, np.full(k, e.log / k)])
        at = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(rows[at, j]) for j in range(k)]], names=["at", *[f"s{j}" for j in range(k)]])

    sums = train.select("classes").mapInArrow(run, "at long, " + ", ".join(f"s{j} double" for j in range(k)))
    found = sums.groupBy("at").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(k)]).toPandas()
    rows = np.zeros((2 + k + len(chain.emit), k))
    rows[found["at"]] = found[[f"s{j}" for j in range(k)]]
    e = Expected(chain)
    e.start, e.move, e.emit = rows[0], rows[1 : 1 + k], rows[1 + k : -1]
    held.unpersist()
    return e.chain_of(), float(rows[-1].sum())


def train_chain(train: DataFrame, class_counts: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Chain:
    """Rounds from the corpus' class counts, early ones over every EARLY-th document by a hash of its place, then over all until they settle."""
    chain, last = first_guess(class_counts, states), -math.inf
    some = train.where(F.pmod(F.xxhash64("row"), F.lit(EARLY)) == 0)
    some = staged(some.coalesce(max(1, some.rdd.getNumPartitions() // EARLY)), "early-classes")
    for _ in range(EARLY_ROUNDS):
        chain, _ = baum_welch_round(some, chain)
    for _ in range(rounds):
        chain, log = baum_welch_round(train, chain)
        if log - last < SETTLED * abs(log):
            break
        last = log
    return chain


def language_scores(docs: DataFrame, held_out, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    held_out: a boolean column over docs; the other rows train. Scores are log10 probabilities of the whole
    text with its end; null and empty texts hold the end alone. Repeated rows and null ids are scored row by row. With
    no training rows all counts are 0 and the states stay at their first guess. Other columns are left out.
    """
    spark = docs.sparkSession
    small_batches(spark, rows=2000)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), text_or_empty().alias("text"))
    train = rows.where(~F.col("held_out"))
    counts = staged(count_words(train), "word-counts")
    vocab = vocabulary(counts, train.count())
    docs_in = staged(encoded(rows, vocab), "word-classes")
    learned = docs_in.where(~F.col("held_out")).select("row", "classes")
    chain = spark.sparkContext.broadcast(train_chain(learned, vocab.class_counts, states, rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.drop_columns(["classes"]).append_column("ll", pa.array(log_likelihood(_sequences(b.column("classes")), chain.value) / math.log(10)))

    plain = "doc_id long, held_out boolean, row long, n_tokens long, known long, base double, within double"
    main = docs_in.drop("rare").mapInArrow(run, f"{plain}, ll double")
    rare = docs_in.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    rare = rare.groupBy("row").agg(F.count("n").alias("rare_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + ADD)).alias("rare_log"))
    out = main.join(rare, "row", "left")
    extra = F.coalesce("rare_log", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"), (F.col("base") + extra).alias("base_score"), (F.col("ll") + F.col("within") + extra).alias("score"))
