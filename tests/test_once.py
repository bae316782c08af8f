"""Costly text expressions are evaluated once: of a row, or of a word."""

import duckdb
from pyspark.sql import functions as F

from cuelake.functions import text
from cuelake.plans import catalog


def documents(spark, tmp_path, texts):
    rows = spark.createDataFrame([(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_counted_before_they_are_judged(spark, tmp_path):
    sf = documents(spark, tmp_path, ["AB12 the the\nXYZ the", "", None, "the internationalisation", "!!"])
    df = catalog.word_shapes(spark, sf)
    assert "Aggregate [lang" in plan_of(df) and ", w#" in plan_of(df).split("Aggregate [lang")[2].split("]")[0]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, df.collect()), key=str) == sorted(con.execute(catalog.SQL["word_shapes"]).fetchall(), key=str)


def test_a_line_is_cleaned_once(spark, tmp_path):
    sf = documents(spark, tmp_path, ["One line\nOne\n\n two  lines ", None])
    for name in ("cues_contained", "cues_identical"):
        assert plan_of(catalog.QUERIES[name](spark, sf)).count(text.TRIM_CHARS) == 1
    assert [r.text for r in catalog.cues_contained(spark, sf).orderBy("start").collect()] == ["One line", "two lines"]


def test_classes_by_number_are_the_classes_by_name(spark):
    rows = spark.range(1, 0x110000).where("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    c = F.concat(F.lit("aB "), "c", "c", F.lit(" ,"), "c")
    share = F.length(F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}{text.in_class(text.PUNCTUATION)}]", "")) / F.greatest(F.length(c), F.lit(1))
    same = (text.strip(F.regexp_replace(c, f"(?U){text.SPACE}+", " ")) == text.squeeze(c)) & (share == text.real_share(c)) & (F.translate(F.lower(c), text.NORMALIZE_DELETES, "") == text.normalize(c))
    assert rows.count() == 0x10FFFF - 2048 and rows.where(~same).count() == 0


def test_letters_of_the_english_window_are_not_gathered(spark, tmp_path):
    sf = documents(spark, tmp_path, ["\n".join(["this is a line of english text"] * 9), "kurz", None])
    df = catalog.english_window(spark, sf)
    assert "extract_all" not in plan_of(df) and "regexp_count" not in plan_of(df)
    assert {r.pos for r in df.where("english").collect()} == set(range(3, 9))


def test_bodies_of_requests_are_made_once(spark, tmp_path):
    rows = [(c, t, "user", f"text {c} {t}") for c in range(4) for t in range(5)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    df = catalog.service_corrections(spark, str(tmp_path))
    assert "to_json" not in plan_of(df).replace("StructsToJson", "to_json")
    assert sorted(map(tuple, df.collect())) == [(c, t, f"> {x}") for c, t, _, x in rows]
