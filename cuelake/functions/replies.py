"""Reading correctors' replies: JSON salvage, correction maps, provider formats and error texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuelake.functions.text import is_safe_correction, squeeze, strip

# Fixed values.
RETRY_MARKS = ["response_format", "json_object", "json mode", "schema", "unsupported", "not supported", "invalid parameter", "invalid_request"]
TEXT_NAMES = ["text", "corrected_text", "correction"]
INDEX_NAMES = ["i", "index", "id"]
LIST_NAMES = ["items", "corrections", "results"]


def json_object(c: Column) -> Column:
    """The JSON object in a reply, as text: fences off, else from the first brace to the last; null without one."""
    v = strip(F.coalesce(c, F.lit("")))
    v = F.when(v.startswith("```"), F.regexp_replace(F.regexp_replace(v, r"^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(v)
    inner = F.regexp_extract(v, r"(?s)\{.*\}", 0)
    ok = lambda x: x.startswith("{") & F.is_variant_null(F.try_parse_json(x)).isNotNull()
    return F.when(ok(v), v).when(ok(inner), inner)


def _first(obj: Column, names: list[str]) -> Column:
    """The first member that is there and not empty."""
    return F.coalesce(*[F.nullif(F.get_json_object(obj, f"$.{n}"), F.lit("")) for n in names])


def correction_map(c: Column) -> Column:
    """MAP<INT, STRING> of a reply's corrections by 1-based index; empty for what can't be used."""
    obj = json_object(c)
    none = F.create_map().cast("map<int,string>")
    one = lambda x: F.create_map(F.lit(1), squeeze(x))
    direct = _first(obj, TEXT_NAMES)
    raw = _first(obj, LIST_NAMES)
    listed = F.from_json(F.when(raw.startswith("["), raw), "array<string>")
    numbers = lambda item: F.coalesce(*[F.nullif(F.get_json_object(item, f"$.{n}").try_cast("int"), F.lit(0)) for n in INDEX_NAMES])
    from_list = F.transform(listed, lambda item: F.struct(numbers(item).alias("i"), _first(item, TEXT_NAMES).alias("t")))
    table = F.from_json(F.when(raw.startswith("{"), raw), "map<string,string>")
    from_table = F.transform(F.map_entries(table), lambda e: F.struct(e.key.try_cast("int").alias("i"), e.value.alias("t")))
    found = F.filter(F.coalesce(from_list, from_table), lambda e: e.i.isNotNull() & is_safe_correction(e.t))
    last = F.filter(found, lambda e, k: ~F.exists(F.slice(found, k + 2, F.size(found)), lambda other: other.i == e.i))
    pairs = F.map_from_entries(F.transform(last, lambda e: F.struct(e.i.alias("key"), squeeze(e.t).alias("value"))))
    return F.when(obj.isNull() | (F.regexp_replace(obj, r"\s", "") == "{}"), F.when(is_safe_correction(c), one(c)).otherwise(none)).when(is_safe_correction(direct), one(direct)).otherwise(F.coalesce(pairs, none))


def reply_text(provider: Column, body: Column) -> Column:
    """The text in a provider's answer; empty if there is none."""
    part = lambda path: F.get_json_object(body, path)
    joined = lambda raw, between="": F.array_join(F.transform(F.from_json(raw, "array<struct<text:string>>"), lambda x: F.coalesce(x.text, F.lit(""))), between)
    content = part("$.choices[0].message.content")
    chat = F.coalesce(F.when(content.startswith("[{"), joined(content)).otherwise(content), part("$.choices[0].text"), part("$.output_text"))
    return F.coalesce(F.when(provider == "anthropic", joined(part("$.content"), "\n")).when(provider == "ollama", part("$.message.content")).otherwise(chat), F.lit(""))


def error_text(body: Column) -> Column:
    """The error that an answer reports; empty if none."""
    part = lambda path: F.nullif(F.get_json_object(body, path), F.lit(""))
    plain = F.when(~F.coalesce(part("$.error").startswith("{"), F.lit(False)), part("$.error"))
    flagged = F.when(F.get_json_object(body, "$.ok") == "false", part("$.message"))
    return F.coalesce(plain, part("$.error.message"), part("$.error.error"), part("$.error.detail"), flagged, F.lit(""))


def wants_plain_retry(message: Column) -> Column:
    """Whether an error speaks of the JSON mode, so that a request without it may work."""
    return F.lower(message).rlike("|".join(RETRY_MARKS))
