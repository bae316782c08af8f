"""Sizes as text at halves, which the query's SQL rounds to even."""

import duckdb
from pyspark.sql import functions as F

from cuelake.plans import catalog


def test_halves_round_as_in_sql(spark, tmp_path):
    sizes = [1023, 1152, 1280, 1408, 1792, 10_752, 11_776, 1_047_040, 11_010_048, 1_342_177_280, 11_274_289_152, 500]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(sizes)], "o_orderkey long, b long")
    rows.select("o_orderkey", F.sqrt(F.col("b") + 0.5).alias("o_totalprice")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = dict(catalog.size_texts(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert got == dict(con.execute(catalog.SQL["size_texts"]).fetchall())
    assert [got[i] for i in (2, 5, 7)] == ["1.2 KB", "10 KB", "1022 KB"]
