"""Choices of languages, engines and job settings as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ENGLISH = ["en", "eng", "english"]
PROVIDERS = ["openai", "anthropic", "ollama", "openai-compatible"]
ENGINE_ORDER = ["openvino", "onnxruntime", "paddle", "easyocr", "tesseract"]
REVIEWED_ENGINES = ["openvino", "onnxruntime"]
REVIEWER = "paddle"
TEXT_CODECS = ["ass", "ssa", "subrip", "srt", "text", "webvtt", "mov_text"]
LANGUAGE_ORDER = ["chi", "zho", "chs", "cht", "zh", "cn"]
VIDEO_SUFFIXES = [".mp4", ".mkv", ".mov", ".avi", ".webm", ".m4v", ".ts", ".flv", ".wmv", ".3gp", ".rmvb"]
PICKED_SUFFIXES = [".mp4", ".mkv", ".mov", ".avi", ".webm", ".m4v", ".ts"]
MODELS = {"openai": "gpt-4.1-mini", "openai-compatible": "gpt-4.1-mini", "anthropic": "claude-3-5-haiku-latest", "ollama": "qwen2.5:7b"}
BASE_URLS = {"openai": "https://api.openai.com/v1", "openai-compatible": "https://api.openai.com/v1", "anthropic": "https://api.anthropic.com", "ollama": "http://127.0.0.1:11434"}


def language_code(c: Column) -> Column:
    """``en`` for the English names, ``ch`` for all others."""
    v = F.translate(F.lower(F.trim(F.coalesce(c, F.lit("ch")))), "_", "-")
    return F.when(v.isin(ENGLISH), F.lit("en")).otherwise(F.lit("ch"))


def provider_name(c: Column) -> Column:
    """A known provider, else ``openai``."""
    v = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(v.isin(PROVIDERS), v).otherwise(F.lit("openai"))


def _lookup(table: dict[str, str], key: Column, other: str) -> Column:
    found = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(found, key), F.lit(other))


def model_name(provider: Column, model: Column) -> Column:
    """The given model, else the provider's."""
    return F.coalesce(F.nullif(F.trim(model), F.lit("")), _lookup(MODELS, provider, MODELS["openai"]))


def base_url(provider: Column, url: Column) -> Column:
    """The given address without its last slashes, else the provider's."""
    return F.coalesce(F.nullif(F.regexp_replace(F.trim(url), "/+$", ""), F.lit("")), _lookup(BASE_URLS, provider, ""))


def joined_url(base: Column, path: Column) -> Column:
    """Two parts of an address with one slash between."""
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", ""))


def profile(mode: Column) -> Column:
    """A known mode, else ``balanced``."""
    return F.when(mode.isin("fast", "balanced", "accurate"), mode).otherwise(F.lit("balanced"))


def has_reviewer(engine: Column, mode: Column, available: Column) -> Column:
    """Whether a second engine reviews: only the light engines, never in fast mode, if the reviewer is available."""
    return F.coalesce(engine.isin(REVIEWED_ENGINES), F.lit(False)) & (F.coalesce(mode, F.lit("")) != "fast") & F.array_contains(available, REVIEWER)


def engine_plan(requested: Column, mode: Column, available: Column) -> Column:
    """struct(engine, review_engine): the named engine or the first available of the order; engine null if none is."""
    name = F.lower(F.trim(F.coalesce(F.nullif(requested, F.lit("")), F.lit("auto"))))
    ordered = F.array(*[F.lit(e) for e in ENGINE_ORDER])
    engine = F.when(name != "auto", name).otherwise(F.get(F.filter(ordered, lambda e: F.array_contains(available, e)), F.lit(0)))
    reviewed = has_reviewer(engine, F.when(name == "auto", profile(mode)).otherwise(mode), available)
    return F.struct(engine.alias("engine"), F.when(reviewed, F.lit(REVIEWER)).otherwise(F.lit("")).alias("review_engine"))


def auto_config(mode: Column, duration: Column, width: Column, height: Column, detected: Column, batch: int = 4) -> Column:
    """Sampling rate, crop, similarity, batch and change threshold for a video by mode, length and shape."""
    p = profile(mode)
    d, w, h = (F.coalesce(x, F.lit(0.0)) for x in (duration, width, height))
    portrait = (w > 0) & (h > 0) & (h > 1.2 * w)
    low = (h > 0) & (h <= 720)
    fast, exact = p == "fast", p == "accurate"
    fps = F.when(fast, F.when(d >= 1200, 0.75).otherwise(1.0)).when(exact, F.when(d <= 1200, 2.0).otherwise(1.5)).otherwise(F.when(portrait | (d >= 1800), 1.0).otherwise(1.5))
    crop = (
        F.when(fast, F.when(portrait, 0.45).otherwise(0.55))
        .when(exact, F.when(portrait, 0.55).when(low, 0.65).otherwise(0.60))
        .otherwise(F.when(portrait, 0.50).when(low, 0.60).otherwise(0.55))
    )
    crop = F.when((w > 0) & (w <= 960) & ~portrait, F.least(crop + 0.05, F.lit(0.75))).otherwise(crop)
    crop = F.when(detected > 0, F.greatest(crop, F.least(detected, F.when(portrait, 0.58).otherwise(0.65)))).otherwise(crop)
    pick = lambda a, b, c: F.when(fast, F.lit(a)).when(exact, F.lit(b)).otherwise(F.lit(c))
    return F.struct(p.alias("mode"), fps.alias("fps"), crop.alias("crop_bottom"), pick(0.76, 0.68, 0.72).alias("similarity"), pick(min(8, max(batch, 4)), min(6, max(batch, 4)), min(6, max(batch, 4))).alias("ocr_batch_size"), pick(0.40, 0.16, 0.30).alias("frame_diff_threshold"))


def resource_plan(cpus: Column, total_gb: Column, available_gb: Column, worker_gb: float = 4.5, forced: Column | None = None, most: Column | None = None) -> Column:
    """struct(cpu_threads, max_workers, worker_count) for a machine."""
    threads = F.least(F.greatest(F.floor(cpus / 2), F.lit(4)), F.lit(12))
    limit = F.greatest(F.lit(1), F.coalesce(most, F.lit(None).cast("int")) if most is not None else F.lit(0), F.when(cpus >= 20, 3).when(cpus >= 12, 2).otherwise(1) if most is None else F.lit(1))
    by_cpu = F.greatest(F.lit(1), F.floor(cpus / F.greatest(F.lit(4), F.least(threads, F.lit(8)))))
    basis = F.coalesce(available_gb, total_gb)
    usable = F.greatest(F.lit(0.0), basis - F.greatest(F.lit(3.5), 0.15 * F.coalesce(total_gb, basis)))
    by_memory = F.when(basis.isNull(), limit).otherwise(F.greatest(F.lit(1), F.floor(usable / max(1.0, worker_gb))))
    auto = F.greatest(F.lit(1), F.least(limit, by_cpu, by_memory))
    count = auto if forced is None else F.when(forced > 0, F.greatest(F.lit(1), F.least(forced, limit))).otherwise(auto)
    return F.struct(threads.cast("int").alias("cpu_threads"), limit.cast("int").alias("max_workers"), count.cast("int").alias("worker_count"))


def is_text_codec(codec: Column) -> Column:
    """Whether a stream's codec is text."""
    return F.lower(codec).isin(TEXT_CODECS)


def is_video_name(name: Column) -> Column:
    """Whether a file name ends as a video does."""
    return F.lower(name).rlike("(" + "|".join(s.replace(".", r"\.") for s in VIDEO_SUFFIXES) + ")$")


def is_video_file(name: Column, mime: Column) -> Column:
    """Whether a picked file is a video, by its type or else its name."""
    named = F.lower(F.coalesce(name, F.lit(""))).rlike("(" + "|".join(s.replace(".", r"\.") for s in PICKED_SUFFIXES) + ")$")
    return F.coalesce(mime.startswith("video/"), F.lit(False)) | named


# --- a settings file ---------------------------------------------------------------------------------------------


def settings_object(content: Column) -> Column:
    """The members of a settings text as MAP<STRING, VARIANT>: empty for null, for what is no JSON and for what is no object."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(content), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def _is_set(v: Column) -> Column:
    """Whether a member counts as true: true, numbers but zero, texts and lists with something in them, records."""
    number = F.try_variant_get(v, "$", "double")
    kind = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    said = F.when(kind == "STRING", F.try_variant_get(v, "$", "string") != "").when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
    return F.coalesce(said.when(kind == "ARRAY", F.size(F.try_variant_get(v, "$", "array<variant>")) > 0).when(kind == "OBJECT", F.size(F.try_variant_get(v, "$", "map<string,variant>")) > 0).otherwise(number != 0), F.lit(False))


def _said(settings: Column, name: str) -> Column:
    """A member as text; empty if it is missing, false or zero."""
    v = F.try_element_at(settings, F.lit(name))
    return F.when(_is_set(v), F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))).otherwise(F.lit(""))


def corrector_settings(content: Column) -> Column:
    """struct(enabled, provider, model, base_url, has_api_key, api_key) of a settings text; defaults for what is missing or broken."""
    llm = F.coalesce(F.try_variant_get(F.try_element_at(settings_object(content), F.lit("llm")), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    return F.get(F.transform(F.array(llm), lambda m: F.struct(
        _is_set(F.try_element_at(m, F.lit("enabled"))).alias("enabled"), provider_name(_said(m, "provider")).alias("provider"), _said(m, "model").alias("model"),
        _said(m, "base_url").alias("base_url"), (F.trim(_said(m, "api_key")) != "").alias("has_api_key"), _said(m, "api_key").alias("api_key"),
    )), F.lit(0))


def saved_settings(content: Column, payload: Column) -> Column:
    """The settings text after a payload (JSON) is saved: a blank key keeps the old one, a missing provider the old provider, other members stay."""
    given, old = settings_object(payload), corrector_settings(content)
    llm = F.struct(
        _is_set(F.try_element_at(given, F.lit("enabled"))).alias("enabled"),
        provider_name(F.coalesce(F.nullif(_said(given, "provider"), F.lit("")), old["provider"])).alias("provider"),
        F.trim(_said(given, "model")).alias("model"), F.trim(_said(given, "base_url")).alias("base_url"),
        F.coalesce(F.nullif(F.trim(_said(given, "api_key")), F.lit("")), old["api_key"]).alias("api_key"),
    )
    others = F.map_filter(settings_object(content), lambda k, _: k != "llm")
    return F.to_json(F.map_concat(others, F.create_map(F.lit("llm"), F.parse_json(F.to_json(llm)))))


def reset_settings(content: Column) -> Column:
    """The settings text without the corrector's; null, for no file, if nothing else is in it."""
    others = F.map_filter(settings_object(content), lambda k, _: k != "llm")
    return F.when(F.size(others) > 0, F.to_json(others))
