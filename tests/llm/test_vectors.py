"""Product codes against a plain version."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import vectors

SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows, entries=256, rounds=4):
    """{vec_id: (code, error, label_error, digest)}, by loops over exact integers."""
    sane = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2]) and len(r[2]) == 8]
    v = {r[0]: [math.floor(1024 * float(np.float32(x))) for x in r[2]] for r in sane}
    cut = {i: [x[2 * k : 2 * k + 2] for k in range(4)] for i, x in v.items()}
    books = [[cut[i][k] for i in sorted(cut)[:entries]] for k in range(4)]
    near = lambda p, book: min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for k in range(4):
            found = {}
            for i in cut:
                found.setdefault(near(cut[i][k], books[k])[1], []).append(cut[i][k])
            for j, points in found.items():
                books[k][j] = [sum(c) // len(points) for c in zip(*points, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    told = {i: [near(cut[i][k], books[k]) for k in range(4)] for i in cut}
    error = {i: sum(d for d, _ in t) for i, t in told.items()}
    label = {r[0]: r[1] for r in sane}
    return {i: ("".join(f"{j:02x}" for _, j in told[i]), error[i], sum(error[j] for j in error if label[j] == label[i]), digest) for i in cut}


def outcome(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("v", "code", "error", "key", "part")})
    return {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in vectors.compressed(df.repartition(3), **options).collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = [(k, rng.choice([None, 0, 1, 1, 1]), [rng.choice([-0.01, 0.0, 0.003, rng.gauss(0, 1)]) for _ in range(8)]) for k in range(400)]
    return out + [(k, 1, [0.5] * 8) for k in range(400, 520)] + [(600, 1, None), (601, 1, [0.1] * 7 + [None]), (602, None, [0.1] * 7 + [float("nan")]), (603, 2, [float("inf")] + [0.0] * 7), (604, 2, [1.0] * 7), (605, 2, []), (606, 2, [1.0] * 12)]


def test_it_is_the_plain_version(spark, rows):
    assert outcome(spark, rows) == plain(rows)


@pytest.mark.parametrize("entries", [1, 5])
def test_few_entries_and_ties(spark, rows, entries):
    assert outcome(spark, rows, entries=entries) == plain(rows, entries)


def test_huge_components_repeats_and_nothing(spark):
    got = outcome(spark, [(1, 1, [3e38] * 4 + [-3e38] * 4), (2, 1, [0.0] * 8)], entries=1)
    assert len(got) == 2 and all(e >= 0 for _, e, _, _ in got.values())
    df = spark.createDataFrame([(1, 1, [0.25] * 8)] * 30 + [(None, None, [0.25] * 8)], SCHEMA)
    same = vectors.compressed(df).collect()
    assert len(same) == 31 and {r.error for r in same} == {0}
    assert vectors.compressed(df.limit(0)).count() == 0
    assert vectors.compressed(df.withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 0


@pytest.mark.parametrize(("scale", "width", "n"), [(100, 16, 256), (2, 3, 256), (1 << 26, 16, 40), (1, 1, 1), (5, 2, 9)])
def test_annuli_lose_nothing(scale, width, n):
    rng = np.random.default_rng(n)
    points, entries = rng.integers(-scale, scale + 1, (700, width)), rng.integers(-scale, scale + 1, (n, width))
    entries[n // 2 :] = entries[: n - n // 2]  # ties
    index, distance = vectors.Annuli(entries).nearest(points)
    every = ((points[:, None, :] - entries[None]) ** 2).sum(-1)
    assert (index == every.argmin(1)).all() and (distance == every.min(1)).all()
