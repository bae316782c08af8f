"""Best-fit packing: every id once, gapless, and about as few sequences as the tokens need."""

import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import bestfit
from cuelake.llm.queries import tokenizer_path

WORDS = "the of and river stone window paper garden silver morning Table letter's engine market, village 1990 signal harbour copper größe".split()


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 0]


def checked(docs, rows, window):
    """The rows are a packing of the documents: cuts, checksums, offsets."""
    want = sorted((i is not None, i or 0, k, at, len(ids[at : at + window]), zlib.crc32(np.array(ids[at : at + window], "<u4").tobytes())) for i, t in docs for ids in [ids_of(t)] for k, at in enumerate(range(0, len(ids), window)))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for some in bins.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= window
    return len(bins), sum(r.length for r in rows)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(k, text(int(rng.expovariate(1 / 60)))) for k in range(500)]
    return rows + [(500, None), (501, ""), (502, "   "), (503, text(9000)), (504, "x" * 4000), (None, text(30)), (7, rows[7][1])]


@pytest.mark.parametrize(("window", "stream", "most"), [(2048, 65_536, 2048), (100, 120, 16), (64, 10_000, 1), (1, 65_536, 3)])
def test_it_is_a_packing(spark, docs, window, stream, most):
    some = docs if window > 1 else docs[:40]
    df = spark.createDataFrame(some, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("piece", "length", "offset", "sequence_id")}).repartition(3)
    rows = bestfit.pack(df, tokenizer_path(), window, most_open=most, stream=stream).collect()
    n, tokens = checked(some, rows, window)
    if most > 100:
        assert n <= -(-tokens // window) + 1


def test_no_documents(spark):
    assert bestfit.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_best_fit_by_hand():
    bins = bestfit.OpenBins(10, 2)
    assert [bins.put(n) for n in (6, 7)] == [(0, 0), (1, 0)]
    assert bins.put(3) == (1, 7)  # the least space that holds it, which fills the bin
    assert bins.put(5) == (2, 0)
    assert bins.put(8) == (3, 0)  # both open bins are too full: the fullest, of 6, closes
    assert bins.put(4) == (2, 5)
    assert bins.put(2) == (3, 8) and bins.open == 1


def plain_best_fit(lengths, window, most):
    free, opened, out, made = {}, [], [], 0
    for n in lengths:
        fits = [b for b in opened if free[b] >= n]
        if fits:
            b = min(fits, key=lambda x: free[x])
        else:
            if len(opened) == most:
                opened.remove(min(opened, key=lambda x: free[x]))
            b, made = made, made + 1
            free[b] = window
            opened.append(b)
        free[b] -= n
        if not free[b]:
            opened.remove(b)
        out.append(free[b])
    return out, made


@pytest.mark.parametrize("most", [1, 3, 50])
def test_bins_against_a_list(most):
    rng = random.Random(most)
    lengths = [rng.choice([1, rng.randint(1, 60), 60]) for _ in range(1500)]
    bins = bestfit.OpenBins(60, most)
    left = [60 - offset - n for n, (_, offset) in ((n, bins.put(n)) for n in lengths)]
    assert (left, bins.made) == plain_best_fit(lengths, 60, most)
