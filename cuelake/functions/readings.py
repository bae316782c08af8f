"""Recognizers' answers of unknown shape, as JSON, to tokens: VARIANT expressions, no Python worker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TEXT_LISTS = ["txts", "texts", "rec_texts"]
INNER = ["result", "res"]
ROW_TEXTS = ["text", "rec_text", "txt"]
ROW_SCORES = ["score", "confidence", "rec_score"]


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _list(v: Column, path: str = "$") -> Column:
    """The elements at a path; null for what is no list."""
    return F.try_variant_get(v, path, "array<variant>")


def _text(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "string")


def _said(texts: Column) -> Column:
    """Those that are neither null nor blank."""
    return F.filter(texts, lambda t: F.trim(F.regexp_replace(t, r"\s+", " ")) != "")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _first(values: list[Column]) -> Column:
    return F.coalesce(*values)


def _row(row: Column) -> Column:
    """struct(text, score) of one row: a record, or a list with its first text and last number; text null if there is none."""
    record_text = _first([F.nullif(_text(row, f"$.{n}"), F.lit("")) for n in ROW_TEXTS])
    numbers = [F.try_variant_get(row, f"$.{n}", "double") for n in ROW_SCORES]
    record_score = _first([*[F.nullif(x, F.lit(0.0)) for x in numbers[:-1]], numbers[-1]])
    parts = _list(row)
    texts = _said(F.transform(F.filter(parts, lambda x: _kind(x) == "STRING"), lambda x: _text(x)))
    scores = F.transform(F.filter(parts, lambda x: _kind(x).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")), lambda x: F.try_variant_get(x, "$", "double"))
    record = _kind(row) == "OBJECT"
    return F.struct(F.when(record, record_text).otherwise(F.get(texts, F.lit(0))).alias("text"), F.when(record, record_score).otherwise(F.try_element_at(scores, F.lit(-1))).alias("score"))


def scored_rows(answer: Column) -> Column:
    """ARRAY<STRUCT<text, score>> of an answer in rows: lists of texts, records, lists of box, text and score, one row alone, each also inside a record.

    Blank texts go. Empty for null, for what is no JSON and for shapes without texts.
    """
    return F.coalesce(_once(F.try_parse_json(answer), _scored), F.array().cast("array<struct<text:string,score:double>>"))


def _scored(v: Column) -> Column:
    record = _kind(v) == "OBJECT"
    named = F.when(record, _first([_list(v, f"$.{n}") for n in TEXT_LISTS]))
    inner = _first([F.when(F.size(_list(v, f"$.{n}")) > 0, F.try_variant_get(v, f"$.{n}", "variant")) for n in INNER])
    rows = lambda p: F.when(F.exists(_list(p), lambda x: _kind(x) == "STRING"), F.array(p)).otherwise(_list(p))
    read = F.filter(F.transform(_once(F.when(record, inner).otherwise(v), rows), _row), lambda r: F.trim(F.regexp_replace(r.text, r"\s+", " ")) != "")
    plain = F.transform(_said(F.transform(named, lambda t: _text(t))), lambda t: F.struct(t.alias("text"), F.lit(None).cast("double").alias("score")))
    return F.coalesce(plain, read)


def _page(page: Column, depth: int) -> Column:
    """The texts of one page: a record's list of texts and what is inside it, else each item's second part's first."""
    record = F.concat(F.coalesce(F.transform(_list(page, "$.rec_texts"), lambda t: _text(t)), F.array().cast("array<string>")), _pages(F.try_variant_get(page, "$.res", "variant"), depth - 1))
    items = F.transform(_list(page), lambda x: _text(x, "$[1][0]"))
    return F.when(_kind(page) == "OBJECT", record).otherwise(items)


def _pages(v: Column, depth: int) -> Column:
    none = F.array().cast("array<string>")
    if not depth:
        return none
    own = F.when(_kind(v) == "OBJECT", F.transform(_list(v, "$.rec_texts"), lambda t: _text(t)))
    pages = F.when(_kind(v) == "ARRAY", _list(v)).otherwise(F.array(v))
    inside = F.flatten(F.transform(pages, lambda p: F.coalesce(_page(p, depth), none)))
    return F.coalesce(own, inside, none)


def page_texts(answer: Column, depth: int = 3) -> Column:
    """ARRAY<STRING> of an answer in pages, which may hold pages in ``res`` down to a depth; empty for null and for what is no JSON."""
    texts = _once(F.try_parse_json(answer), lambda v: _pages(v, depth))
    return F.filter(texts, lambda t: t.isNotNull())
