"""Items and documents at the edges: repeated and null ids, short and blank texts, empty tables, any block size."""

import pytest
from pyspark.sql import functions as F

from cuelake.llm import decontaminate

SEVEN = "a passage of some length that a benchmark item number seven holds"
OTHER = "another wholly different text which stands under the same number"


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("item_id", "distance", "end")})
    return d, spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))


@pytest.mark.parametrize("block", [1, 2, 2000])
def test_repeated_and_null_ids(spark, block):
    docs = [(1, f"before {SEVEN} after"), (2, OTHER.upper()), (3, "clean words alone"), (3, SEVEN), (None, f"x {OTHER}"), (4, None), (5, ""), (6, "  ")]
    items = [(7, SEVEN), (7, OTHER), (7, SEVEN), (None, OTHER), (8, None), (9, "  ")]
    d, b = frames(spark, docs, items)
    got = sorted((r.doc_id or 0, r.item_id or 0, r.distance) for r in decontaminate.matches(d, b, block=block).collect())
    assert got == [(0, 0, 0), (0, 7, 0), (1, 7, 0), (2, 0, 0), (2, 7, 0), (3, 7, 0)]
    kept = decontaminate.drop_contaminated(d, b, block=block)
    assert kept.columns == d.columns and sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(3, "clean words alone"), (4, ""), (5, ""), (6, "  ")]


def test_short_items_and_empty_tables(spark):
    d, b = frames(spark, [(1, "banana"), (2, "bnn")], [(1, "a")])
    assert [(r.doc_id, r.distance) for r in decontaminate.matches(d, b).collect()] == [(1, 0)]
    none_d, none_b = frames(spark, [], [])
    assert decontaminate.matches(none_d, b).count() == 0 and decontaminate.matches(d, none_b).count() == 0
    assert decontaminate.drop_contaminated(none_d, b).count() == 0 and decontaminate.drop_contaminated(d, none_b).count() == 2


def test_a_very_long_text(spark):
    d, b = frames(spark, [(1, "filler words " * 60_000 + SEVEN.replace("length", "lenght")), (2, "filler words " * 60_000)], [(7, SEVEN)])
    assert [(r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(d, b).collect()] == [(1, 7, 2)]
    assert [r.doc_id for r in decontaminate.drop_contaminated(d, b).collect()] == [2]
