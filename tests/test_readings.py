"""Answers of unknown shape."""

import json

from pyspark.sql import functions as F

from cuelake.functions import readings

ROWS = [
    (None, []),
    ("no json", []),
    ("null", []),
    ("3", []),
    ("[]", []),
    ("{}", []),
    ([[[[0, 0], [1, 1]], "hello", 0.9], [[[0, 0]], "world", 1]], [("hello", 0.9), ("world", 1.0)]),
    ([[0, 0], "hello", 0.5], [("hello", 0.5)]),
    (["  ", "hello", 0.5, 2], [("hello", 2.0)]),
    ({"txts": ["a", "", " \n", "b"], "scores": [1, 2]}, [("a", None), ("b", None)]),
    ({"txts": "no list", "rec_texts": ["c", 7]}, [("c", None), ("7", None)]),
    ({"texts": [], "result": [{"text": "x"}]}, []),
    ({"result": [], "res": [{"rec_text": "x", "confidence": 0.25}, {"txt": "y", "score": "0.5"}, {"text": "", "rec_text": "z", "score": 0, "rec_score": 0}, {"text": " "}, {"other": "w"}, [1], 5, None]}, [("x", 0.25), ("y", 0.5), ("z", 0.0)]),
    ([{"text": "x", "score": "high"}], [("x", None)]),
    ([[None, "deep", None]], [("deep", None)]),
]
PAGES = [
    (None, []),
    ("{", []),
    ("null", []),
    ({"rec_texts": ["hello", "world"], "res": {"rec_texts": ["never"]}}, ["hello", "world"]),
    ([{"rec_texts": ["a"], "res": {"rec_texts": ["b"]}}, None, {"res": [{"rec_texts": ["c"]}]}], ["a", "b", "c"]),
    ([[[[[0, 0]], ["hello", 0.9]], [[[0, 0]], ["world", 0.8]], [1], "x"]], ["hello", "world"]),
    ({"res": {"res": {"rec_texts": ["third"]}}}, ["third"]),
    ({"res": {"res": {"res": {"rec_texts": ["too deep"]}}}}, []),
]


def rows_of(spark, cases):
    return spark.createDataFrame([(k, a if a is None or isinstance(a, str) else json.dumps(a)) for k, (a, _) in enumerate(cases)], "k int, answer string")


def test_scored_rows(spark):
    got = rows_of(spark, ROWS).select("k", readings.scored_rows(F.col("answer")).alias("rows"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.k: [tuple(x) for x in r.rows] for r in got.collect()} == {k: want for k, (_, want) in enumerate(ROWS)}


def test_page_texts(spark):
    got = rows_of(spark, PAGES).select("k", readings.page_texts(F.col("answer")).alias("texts")).collect()
    assert {r.k: r.texts for r in got} == {k: want for k, (_, want) in enumerate(PAGES)}
