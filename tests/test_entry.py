"""Registered queries: they run, and those with SQL give what DuckDB gives, at the smallest scale."""

import math
import os
import re

import pytest

import __spark_entry__ as entry
from cuelake.functions import text

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(k for k in entry.queries() if not k.startswith("op") and k != "pipeline")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def same(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return repr(round(x, 9)) if isinstance(x, float) else str(x)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(same(v[k]) for k in order) for v in values)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    found = [tuple(r) for r in got.collect()]
    if name in entry.oracle_sql():
        want = duck.execute(entry.oracle_sql()[name])
        columns = [d[0] for d in want.description]
        assert sorted(got.columns) == sorted(columns)
        assert rows(got.columns, found) == rows(columns, want.fetchall())
    else:
        assert found


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def plain_repair(line):
    """The cascade of repairs by Python's re, for lines that aren't noise."""
    x = line.strip()
    for p, r in text.REPAIRS:
        x = re.sub(rf"\b{p}\b", r, x, flags=re.I)
    x = re.sub(r",(?=\S)", ", ", x)
    x = re.sub(r"\.{2,}$", ".", x)
    return re.sub(r"^ah\s+\.\S+\s+", "", re.sub(r"^G Plug-in\b", "MG Plug-in", x), flags=re.I)


def test_repair_takes_every_line(spark, tmp_path):
    said = ["élan tomake ça,voilà et plus..", "das ist tomake größer", "étomake reste entier ici", "ici tomakeé reste aussi", "plain words tomake here,now", "Ünder evoletion über alles"]
    docs = [(k, line, lang) for k, line in enumerate(said) for lang in [["fr", "de", "en", None][k % 4]]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.fixed for r in entry.queries()["repair_all_lines"](spark, str(tmp_path)).collect()}
    assert got == {k: plain_repair(line) for k, line, _ in docs}


def test_whole_tables_have_every_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()
    got = entry.queries()["repair_all_lines"](spark, SF)
    assert got.count() == sum(len((r.text or "").split("\n")) for r in docs)
    parsed = entry.queries()["llm_parse_all"](spark, SF).collect()
    assert len(parsed) == spark.read.parquet(f"{SF}/conversations.parquet").count()
    assert all(r.n == 0 and r.fixed is None for r in parsed if r.turn == 0) and any(r.turn == 0 for r in parsed)
