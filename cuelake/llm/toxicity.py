"""Toxicity: a gapped-subsequence string kernel, Nyström landmarks and a support vector machine.

A unit is a word without its punctuation, or a run of single letters joined ("i d i o t"). The kernel counts the common
subsequences of three letters of two units, each gap at a price, so letters put in or left out lower it little.
Sentences of labelled documents take their document's label. Units that stand out in toxic sentences are the marks; marks
with a common beginning have a stem. Units near a mark or stem, toxic or not, are the machine's examples, weighted by the
documents of either label that hold them, each document one in all, marks also with letters put in. So a stem's
harmless forms are learned too, and what one unit alone is worth. A
document's score is a logistic curve over its three largest margins of different units, how many count and what they add up to,
and how many units it has, as a long clean text holds more harmless forms than a short one; it is fitted on training documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import small_batches, staged, text_or_empty

ORDER, DECAY, LONGEST = 3, 0.85, 24
#: Labelled rows that the classifier is fitted on at most, and what of their units reaches the driver.
SAMPLE, MARKS, EXAMPLES, LANDMARKS, TOP = 20_000, 64, 3000, 128, 3
CUT, CACHE, KNOTS = 0.7, 1_000_000, (0.5, 1.0, 1.5)
WIDTH = TOP + 3
NOT_ALNUM = re.compile(r"[\W_]+")
SINGLES = re.compile(r"(?<![^\W_])[^\W_](?:[\W_]{1,3}[^\W_](?![^\W_])){2,}")
SENTENCE = re.compile(r"[.!?]+\s+|\n+")


def _codes(units: list[str], width: int, blank: int) -> np.ndarray:
    out = np.full((len(units), width), blank, np.int32)
    for k, u in enumerate(units):
        out[k, : len(u)] = [ord(c) for c in u[:width]]
    return out


def _kernel(s: np.ndarray, t: np.ndarray, order: int, decay: float) -> np.ndarray:
    """The gap-weighted subsequence kernel of letter arrays (..., S) and (..., T), by its recursion over s."""
    shape = np.broadcast_shapes(s.shape[:-1], t.shape[:-1])
    width = t.shape[-1]
    prefix = [np.zeros((*shape, width + 1), np.float32) for _ in range(order)]
    prefix[0] += 1
    total = np.zeros(shape, np.float32)
    for x in range(s.shape[-1]):
        same = (s[..., x, None] == t).astype(np.float32) * decay**2
        total += (same * prefix[order - 1][..., :-1]).sum(-1)
        for i in range(order - 1, 0, -1):
            now = np.zeros(shape, np.float32)
            hit = same * prefix[i - 1][..., :-1]
            prefix[i][..., 1:] *= decay
            for j in range(width):
                now = now * decay + hit[..., j]
                prefix[i][..., j + 1] += now
    return total


def windows(unit: str) -> list[str]:
    """A long unit as overlapping windows; what is compared is always the whole unit."""
    return [unit] if len(unit) <= LONGEST else [unit[a : a + LONGEST] for a in range(0, len(unit) - LONGEST // 2, LONGEST // 2)]


def string_kernel(left: list[str], right: list[str], order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The kernel of every left with every right unit (of at most LONGEST letters), scaled to 1 for equal units."""
    if not left or not right:
        return np.zeros((len(left), len(right)), np.float32)
    a, b = (_codes(x, max(map(len, x), default=1) or 1, k) for x, k in ((left, -1), (right, -2)))
    own = lambda x, y: np.maximum(_kernel(x, y, order, decay), 1e-12)
    aa, bb = own(a, np.where(a == -1, -3, a)), own(b, np.where(b == -2, -3, b))
    return _kernel(a[:, None, :], b[None, :, :], order, decay) / np.sqrt(aa[:, None] * bb[None, :])


def chunks(text: str) -> list[str]:
    """The text's raw units: lower-case words between white space, and joined runs of single letters."""
    low = text.lower()
    out = low.split()
    out += [NOT_ALNUM.sub("", m[0]) for m in SINGLES.finditer(low)]
    return out


def unit(chunk: str) -> str:
    """A chunk without punctuation."""
    return chunk if chunk.isalnum() else NOT_ALNUM.sub("", chunk)


def stems(marks: list[str], letters: int = 5, least: int = 3) -> list[str]:
    """The marks, those of which at least three begin alike as what they have in common."""
    groups: dict[str, list[str]] = {}
    for m in marks:
        groups.setdefault(m[:letters], []).append(m)
    return sorted({commonprefix(g) if len(g) >= least else m for g in groups.values() for m in g})


def near_pattern(marks: list[str]) -> str:
    """What a unit must hold to be compared: a stem's letters in order with at most two between, or all but one of them."""
    def gapped(s: str) -> str:
        return ".{0,2}".join(map(re.escape, s))

    found = stems(marks)
    ways = {gapped(m) for m in found} | {gapped(m[:i] + m[i + 1 :]) for m in found if len(m) > 4 for i in range(len(m))}
    return "|".join(sorted(ways))


def bent(tops: np.ndarray) -> np.ndarray:
    """The curve's inputs: a text's figures, what the first is over each knot, and one."""
    first = tops[:, :1]
    return np.hstack([tops, *[np.maximum(first - k, 0) for k in KNOTS], np.ones_like(first)])


@dataclass
class Model:
    """Landmarks and the margin's weights over kernel values, and the curve's over the largest margins and one."""

    landmarks: list[str] = field(default_factory=list)
    marks: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    curve: np.ndarray = field(default_factory=lambda: np.array([0.0] * (WIDTH + len(KNOTS)) + [-20.0]))

    def margins(self, units: list[str]) -> np.ndarray:
        """The machine's margin of each unit, of long ones the largest of their windows'."""
        parts = sorted(((k, w) for k, u in enumerate(units) for w in windows(u)), key=lambda x: len(x[1]))  # like lengths share a batch
        got = np.concatenate([string_kernel([w for _, w in parts[a : a + 512]], self.landmarks) @ self.weights + self.bias for a in range(0, len(parts), 512)] or [np.zeros(0)])
        out = np.full(len(units), Scorer.FLOOR)
        np.maximum.at(out, [k for k, _ in parts], got)
        return out

    def score(self, tops: np.ndarray) -> np.ndarray:
        """Rows of largest margins as probabilities."""
        return 1 / (1 + np.exp(-np.clip(bent(tops) @ self.curve, -30, 30)))


class Scorer:
    """Figures of texts: largest margins, logarithms of how many count and of their sum, and less that of the units; what is known of a word is kept between batches, up to a bound."""

    FLOOR = -1.0

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}
        self.near = re.compile(near_pattern(model.marks), re.DOTALL) if model.marks else None

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.full((len(texts), WIDTH), self.FLOOR)
        out[:, TOP:] = 0
        if self.near is None:
            return out
        if len(self.known) > CACHE:
            self.known.clear()
        all_units = [chunks(t) for t in texts]
        known, find, close = self.known, self.near.search, {}
        for units in all_units:
            for c in units:
                if c not in known:
                    known[c] = None
                    if find(u := unit(c)):
                        close.setdefault(u, []).append(c)
        for u, m in zip(close, self.model.margins(list(close)), strict=True):
            for c in close[u]:
                known[c] = u, max(self.FLOOR, float(m))
        for k, units in enumerate(all_units):
            own = set(units)
            out[k, TOP + 2] = -math.log1p(len(own))
            hits = dict(x for x in map(known.__getitem__, own) if x)
            if hits:
                best = sorted(hits.values(), reverse=True)[:TOP]
                out[k, : len(best)] = best
                over = [m - self.FLOOR / 2 for m in hits.values() if m > self.FLOOR / 2]
                out[k, TOP : TOP + 2] = math.log1p(len(over)), math.log1p(sum(over))
        return out


def _tops(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text and what else they have) without the text, with their largest margins and score."""
    small_batches(docs.sparkSession)
    kept = [f.name for f in docs.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            tops = scorer([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(tops.tolist(), pa.list_(pa.float64())), pa.array(model.score(tops))], names=[*kept, "tops", "score"])

    return docs.mapInArrow(run, docs.select(*kept, F.array(F.lit(0.0)).alias("tops"), F.lit(0.0).alias("score")).schema)


def _unit_counts(labelled: DataFrame) -> DataFrame:
    """(unit, pos, neg): in how many different sentences of either label a unit stands."""
    small_batches(labelled.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(y, s) for y, t in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True) for s in SENTENCE.split(t) if s]
            for a in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in rows[a : a + 20_000]], pa.int32()), pa.array([s for _, s in rows[a : a + 20_000]], pa.string())], names=["toxic", "sentence"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: tuple[Counter, Counter] = Counter(), Counter()
            for y, s in zip(b.column("toxic").to_pylist(), b.column("sentence").to_pylist(), strict=True):
                n[y].update({u for c in chunks(s) if ORDER <= len(u := unit(c)) <= LONGEST})
            names = list(n[0].keys() | n[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n[1][u] for u in names], pa.int64()), pa.array([n[0][u] for u in names], pa.int64())], names=["unit", "pos", "neg"])

    sentences = labelled.mapInArrow(cut, "toxic int, sentence string").groupBy("sentence").agg(F.max("toxic").alias("toxic"))
    return sentences.select("toxic", "sentence").mapInArrow(count, "unit string, pos long, neg long").groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _near_units(labelled: DataFrame, marks: list[str]) -> DataFrame:
    """(unit, pos, neg): what the units near a mark weigh in documents of either label, each document one in all."""
    pattern = near_pattern(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern, re.DOTALL).search
        for b in batches:
            n: tuple[Counter, Counter] = Counter(), Counter()
            for y, t in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True):
                hits = {u for c in set(chunks(t)) if len(u := unit(c)) <= LONGEST and find(u)}
                for u in hits:
                    n[y][u] += 1 / len(hits)
            names = list(n[0].keys() | n[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([float(n[1][u]) for u in names], pa.float64()), pa.array([float(n[0][u]) for u in names], pa.float64())], names=["unit", "pos", "neg"])

    return labelled.select("toxic", "text").mapInArrow(run, "unit string, pos double, neg double").groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _variants(mark: str) -> list[str]:
    """A mark with a letter put in at each inner place."""
    return [mark[:i] + c + mark[i:] for i in range(1, len(mark)) for c in ("x", mark[i - 1])]


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1.0) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps on its active rows; the last column of x is the bias."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        on = y * (x @ w) < 1
        xa, wa = x[on], weight[on, None]
        new = np.linalg.solve(np.eye(len(w)) + 2 * cost * xa.T @ (xa * wa), 2 * cost * xa.T @ (y[on] * weight[on]))
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic weights by damped Newton steps with a small ridge; all but the last are kept from falling below zero."""
    w = np.zeros(x.shape[1])
    loss = lambda w: (weight * np.logaddexp(0, -(2 * y - 1) * (x @ w))).sum() + 0.5 * ridge * (w @ w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (p - y)) + ridge * w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        w[:-1] = np.maximum(w[:-1], 0)
        if np.abs(size * step).max() < 1e-7:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the documents (doc_id, text) that labels (doc_id, toxic) mark.

    Labelled documents beyond sample are thinned to it by a hash of their id (0.95 of it on average, so not above). Null labels or texts teach
    nothing; of a document's several labels the largest counts. Without a unit that stands out in toxic
    sentences the model scores every text alike, at the share of toxic documents.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = 0.95 * sample / max(1, marks.count())
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < share * (1 << 40))
    labelled = staged(docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks), "doc_id"), "labelled")
    share = labelled.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    base = min(max(share or 1e-6, 1e-6), 1 - 1e-6)
    flat = Model(curve=np.array([0.0] * (WIDTH + len(KNOTS)) + [math.log(base / (1 - base))]))
    units = staged(_unit_counts(labelled), "toxic-units")
    n_pos, n_neg = units.agg(F.sum("pos"), F.sum("neg")).first()
    if not n_pos or not n_neg:
        return flat
    odds = F.log(((F.col("pos") + 0.1) / n_pos) / ((F.col("neg") + 0.1) / n_neg))
    strong = units.where(F.col("pos") >= 3).withColumn("strength", odds * F.sqrt("pos")).where((odds > 2.0) & (F.col("strength") > 6))
    found = [r[0] for r in strong.orderBy(F.desc("strength"), "unit").limit(MARKS).collect()]
    if not found:
        return flat
    near = _near_units(labelled, found).orderBy(F.desc(F.round(F.col("pos") + F.col("neg"), 6)), "unit").limit(EXAMPLES).collect()
    rows = [(r[0], 1.0, float(r[1])) for r in near if r[1]] + [(r[0], -1.0, float(r[2])) for r in near if r[2]]
    counts = {r[0]: r[1] for r in near}
    alone = sorted(set(stems(found)) & {r[0] for r in near if r[0] in found and r[2] <= 0.05 * r[1]})  # toxic without exception
    rows += [(v, 1.0, counts[m] / 4) for m in alone for v in _variants(m)]
    harmless = [r[0] for r in sorted(near, key=lambda r: (-r[2], r[0])) if r[2] and r[0] not in found]
    landmarks = (found + harmless)[:LANDMARKS]
    values, vectors = np.linalg.eigh(string_kernel(landmarks, landmarks).astype(float))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-4))) @ vectors.T
    texts, y, weight = [r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    k = np.concatenate([string_kernel(texts[a : a + 512], landmarks) for a in range(0, len(texts), 512)]).astype(float)
    w = _machine(np.hstack([k @ root, np.ones((len(rows), 1))]), y, weight)
    model = Model(landmarks, found, root @ w[:-1], float(w[-1]))
    got = _tops(labelled, model).select("tops", "toxic").collect()
    tops, y = np.array([r[0] for r in got]), np.array([float(r[1]) for r in got])
    alone = [v for m in alone for v in (m, *_variants(m))]  # one such unit is enough, also with letters put in
    extra = np.full((len(alone), WIDTH), Scorer.FLOOR)
    extra[:, 0], extra[:, TOP], extra[:, TOP + 2] = model.margins(alone), math.log(2), tops[:, TOP + 2].mean()
    extra[:, TOP + 1] = np.log1p(np.maximum(extra[:, 0] - Scorer.FLOOR / 2, 0))
    weight = np.concatenate([np.ones(len(y)), np.full(len(alone), 0.2 * y.sum() / max(1, len(alone)))])
    model.curve = _logistic(bent(np.vstack([tops, extra])), np.concatenate([y, np.ones(len(alone))]), weight)
    return model


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """(doc_id, score, predicted) of every row from its text alone; null and empty texts score as one without units.

    Repeated rows keep their rows, a null doc_id is kept, other columns are left out.
    """
    rows = _tops(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), model)
    return rows.select("doc_id", "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows whose text scores below the cut, unchanged, each judged by its own text."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            yield b.filter(pa.array(model.score(scorer([t or "" for t in b.column(at).to_pylist()])) < cut))

    return docs.mapInArrow(run, docs.schema)
