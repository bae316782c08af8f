"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import resample


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def found(t, buckets=10_000):
    w = words(t)
    runs = [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    return len(w), Counter(zlib.crc32(r.encode()) % buckets for r in runs)


def plain(docs, target):
    """doc_id -> (n_features, weight, score, rank) for ids that occur once."""
    own, aim = [found(t) for _, t in docs], [found(t)[1] for t in target]
    s, t = sum((c for _, c in own), Counter()), sum(aim, Counter())
    alls, allt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (alls + 10000) / ((s[b] + 1) * (allt + 10000)))) for b in s}
    rows = []
    for (i, _), (n, c) in zip(docs, own, strict=True):
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * k for b, k in c.items())
        rows.append((i, n, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    rank = {r[0]: k + 1 for k, r in enumerate(enough[: len(enough) * 5 // 100])}
    return sorted(((r[0] is not None, r[0] or 0, *r[2:], rank.get(r[0], 0)) for r in rows))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    some = ["river", "Stone", "größe", "x" * 70, "naïve", "7", "a1", "的", "THE", "of"]
    prose = lambda n: " ".join(rng.choice(some) + rng.choice(["", "", ",", " -", "\n"]) for _ in range(n))
    rows = [(k, prose(rng.randint(0, 60))) for k in range(300)]
    return rows + [(300, None), (301, ""), (302, "  ,.-"), (303, "one"), (304, prose(4000)), (305, "y" * 3000), (None, prose(30)), (307, rows[0][1])]


def test_it_is_the_plain_version(spark, docs):
    rng = random.Random(9)
    target = ["the river of stone", None, "größe größe größe 7"] + [" ".join(rng.choice(["river", "of", "silver"]) for _ in range(40)) for _ in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("block", "range", "score", "rank", "place", "words")}).repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string").withColumn("doc_id", F.lit("clash"))
    got = resample.resample(df, aim).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_features, r.weight, r.score, r["rank"] or 0) for r in got) == plain(docs, target)


def test_repeated_rows_and_empty_tables(spark):
    text = " ".join(f"w{k}" for k in range(25))
    df = spark.createDataFrame([(1, text)] * 40 + [(2, text)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    got = resample.resample(df, none).collect()
    assert len(got) == 41 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2] and len({r.weight for r in got}) == 1
    assert resample.resample(none, df).count() == 0


def test_features_in_stretches(monkeypatch, docs):
    texts = [(t or "").encode() for _, t in docs]
    whole = resample.features(texts)
    monkeypatch.setattr(resample, "STRETCH", 50)
    monkeypatch.setattr(resample, "AT_ONCE", 7)
    monkeypatch.setattr(resample, "CACHE", 3)
    parts = resample.features(texts)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    want = sorted(b * len(texts) + k for k, t in enumerate(texts) for b, n in found(t.decode())[1].items() for _ in range(n))
    assert whole[1].tolist() == want and whole[0].tolist() == [len(words(t.decode())) for t in texts]


def test_packed_numbers():
    for v in ([], [0], [254, 255, 256, 1 << 40, 0, 255], list(range(600))):
        assert resample._unpacked(resample._packed(np.array(v, np.int64))).tolist() == v
