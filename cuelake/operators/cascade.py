"""Expensive recognizers and correctors, called only on the rows that need them.

A recognizer is any callable from a list of inputs to a list of texts; a maker of one is called once a Python worker and
name, so that a model loads once. Nothing here needs a particular engine: pass your own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.functions.config import provider_name
from cuelake.functions.readings import ROW_SCORES, ROW_TEXTS
from cuelake.functions.replies import correction_map
from cuelake.functions.text import accepts_token, is_hard_noise, needs_review, prefers_review
from cuelake.operators import asking, scan
from cuelake.operators.sequence import chunked, english_window
from cuelake.staging import new_path, staged

Recognizer = Callable[[list], list]
_loaded: dict[tuple, Recognizer] = {}


def _key(name: str, make: Callable[[], Recognizer], language: str, batch: int) -> tuple:
    """What a loaded recognizer is kept by: a name alone would hand one maker's or language's model to another."""
    return name, language, batch, hashlib.sha256(cloudpickle.dumps(make)).hexdigest()


def _get(key: tuple, make: Callable[[], Recognizer]) -> Recognizer:
    if key not in _loaded:
        _loaded[key] = make()
    return _loaded[key]


def recognize(df: DataFrame, source: str, out: str, name: str, make: Callable[[], Recognizer], batch: int = 64, language: str = "") -> DataFrame:
    """df with the recognizer's text of the source column; batches bound what it holds."""
    return _recognized(df, [source], out, None, name, make, batch, language)


def _recognized(df: DataFrame, sources: list[str], out: str, only: str | None, name: str, make: Callable[[], Recognizer], batch: int, language: str, first: bool = False) -> DataFrame:
    """One pass: the first source's text of the rows that the column ``only`` allows (of all, if ``first``), then each later source on rows still empty."""
    at, key = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]), _key(name, make, language, batch)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = _get(key, make)
        for b in batches:
            texts: list = [None] * len(b)
            for k, s in enumerate(sources):
                values = list(b[s])
                allowed = b[only] if only else [True] * len(b)
                rows = [i for i, ok in enumerate(allowed) if (ok or (k == 0 and first)) and (k == 0 or (not (texts[i] or "").strip() and values[i] is not None))]
                for a in range(0, len(rows), batch):
                    some = rows[a : a + batch]
                    for i, t in zip(some, call([values[i] for i in some]), strict=True):
                        texts[i] = t
            yield b.assign(**{out: texts})

    return df.mapInPandas(run, at)


def recognize_anchors(df: DataFrame, keys: list[str], order: list[str], source: str, name: str, make: Callable[[], Recognizer]) -> DataFrame:
    """text for all rows with island and repeat: rows that don't repeat are recognized, repeats carry their island's first text.

    One pass over df. Rows are dealt by island, so a huge job spreads; a null key is a job like any other.
    """
    read = _recognized(df.withColumn("__anchor", ~F.col("repeat")), [source], "__text", "__anchor", name, make, 64, "").drop("__anchor")
    carried = scan.first_of_run(scan.whole(read), keys, order, "island", F.col("__text"), "text")
    return carried.withColumn("text", F.when(F.col("repeat"), F.col("text")).otherwise(F.col("__text"))).drop("__text", scan.CUTS)


def recognize_with_retry(df: DataFrame, sources: list[str], name: str, make: Callable[[], Recognizer], eligible: Column | bool = True, batch: int = 64, language: str = "") -> DataFrame:
    """text from the first source that gives one: the first is read on all rows, each later crop on rows still empty and eligible, in the same pass."""
    allowed = F.lit(eligible) if isinstance(eligible, bool) else F.coalesce(eligible, F.lit(False))
    return _recognized(df.withColumn("__eligible", allowed), sources, "text", "__eligible", name, make, batch, language, first=True).drop("__eligible")


def review(df: DataFrame, text: str, source: str, name: str, make: Callable[[], Recognizer], batch: int = 64, language: str = "") -> DataFrame:
    """Second readings of suspicious texts; reviewed marks those that replace the first, hard noise else goes. One pass over df."""
    doubtful = df.withColumn("__doubtful", needs_review(F.col(text)))
    read = _recognized(doubtful, [source], "__second", "__doubtful", name, make, batch, language)
    better = F.col("__doubtful") & prefers_review(F.col(text), F.col("__second"))
    kept = F.when(better, F.col("__second")).when(F.col("__doubtful") & is_hard_noise(F.col(text)), F.lit("")).otherwise(F.col(text))
    return read.withColumn("reviewed", better).withColumn(text, kept).drop("__doubtful", "__second")


def chosen(df: DataFrame, text: str, second: str) -> DataFrame:
    """The better of two readings of suspicious rows, and whether it is the second."""
    better = prefers_review(F.col(text), F.col(second))
    kept = F.when(better, F.col(second)).when(is_hard_noise(F.col(text)), F.lit("")).otherwise(F.col(text))
    return df.withColumn("__text", kept).withColumn("reviewed", better).drop(text).withColumnRenamed("__text", text)


def accepted_text(tokens: Column) -> Column:
    """The accepted tokens of a scored reading (array of text and score), joined by spaces."""
    return F.array_join(F.transform(F.filter(tokens, lambda t: accepts_token(t.text, t.score)), lambda t: F.trim(t.text)), " ")


def flattened(result: object) -> list[dict]:
    """Tokens (text, score) of a recognizer's nested answer inside a worker: pairs, triples with a box, records or plain strings; blank texts go.

    Answers that are kept as JSON are read by functions.readings in the JVM.
    """
    return [x for x in _flattened(result) if x["text"].strip()]


def _flattened(result: object) -> list[dict]:
    if result is None:
        return []
    if isinstance(result, str):
        return [{"text": result, "score": None}]
    if isinstance(result, dict):
        for t in ("rec_texts", "texts", "txts"):
            if result.get(t) is not None:
                found = next((result[s] for s in ("rec_scores", "scores") if result.get(s) is not None), [])
                return [{"text": str(x), "score": _number(found[k] if k < len(found) else None)} for k, x in enumerate(result[t])]
        text = next((result[t] for t in ROW_TEXTS if result.get(t)), None)
        if text is not None:
            return [{"text": str(text), "score": _number(next((result[s] for s in ROW_SCORES if result.get(s) is not None), None))}]
        return [x for v in result.values() for x in _flattened(v) if isinstance(v, (list, tuple, dict))]
    if isinstance(result, (list, tuple)):
        if len(result) == 2 and isinstance(result[0], str) and _number(result[1]) is not None:
            return [{"text": result[0], "score": _number(result[1])}]
        if len(result) >= 3 and isinstance(result[1], str):
            return [{"text": result[1], "score": _number(result[2])}]
        return [x for v in result if not isinstance(v, (int, float)) for x in _flattened(v)]
    return []


def _number(x: object) -> float | None:
    try:
        return None if x is None else float(x)
    except (TypeError, ValueError):
        return None


def retry_eligible(mode: Column) -> Column:
    """Whether empty readings are tried again: in accurate and manual mode only."""
    return F.coalesce(mode.isin("accurate", "manual"), F.lit(False))


def engine_languages(df: DataFrame, keys: list[str], order: list[str], text: str, language: Column, batch: int = 1) -> DataFrame:
    """engine_language: English after the first row on whose trailing rows are mostly English, else the given one.

    Time order decides, so the result doesn't depend on how Spark batches rows. batch: how many rows are read between two looks at
    the trailing rows; the switch comes into force after such a block of rows.
    """
    seen = english_window(df if scan.CUTS in df.columns else scan.segmented(df, keys, order), keys, order, text)
    if batch > 1:
        seen = scan.placed(seen, keys, order, "__place").withColumn("english", F.col("english") & (F.col("__place") % batch == batch - 1)).drop("__place")
    ever = scan.running(seen, keys, order, {"__ever": ("max", F.col("english").cast("int"))}, "before")
    return ever.withColumn("engine_language", F.when(F.col("__ever") == 1, F.lit("en")).otherwise(language)).drop("__ever")


def recognize_switching(df: DataFrame, keys: list[str], order: list[str], source: str, name: str, make: Callable[[str], Recognizer], language: str = "ch", batch: int = 1) -> DataFrame:
    """text and engine_language: rows are read in the given language, and those after a job's switch to English once more in English.

    make gets a language and returns a recognizer. The first reading is written to the shared folder, as its texts decide
    where each job switches; the second one meets only rows whose language changed. The texts are those of a loop that reads blocks of
    ``batch`` rows in order and looks at the last rows after each.
    """
    read = staged(recognize(df, source, "text", name, partial(make, language), language=language), "first-reading")
    if language == "en":
        return read.withColumn("engine_language", F.lit("en"))
    told = engine_languages(read, keys, order, "text", F.lit(language), batch).drop("english")
    same, changed = told.where(F.col("engine_language") == language), told.where(F.col("engine_language") != language)
    return same.unionByName(recognize(changed.drop("text"), source, "text", name, partial(make, "en"), language="en"))


def flush_rows(df: DataFrame, keys: list[str], order: list[str], batch: int) -> DataFrame:
    """df (keys, order, repeat) with flush: whether a batch of readings ends at a row.

    A batch begins at a row that doesn't repeat and ends when it has ``batch`` rows, repeats among them; repeats outside a batch belong to none.
    Rows are dealt by job, sorted, and folded with a count as the only state.
    """
    names = df.columns

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, pending = None, 0
        for b in batches:
            out = []
            for k, repeat in zip(b["__job"], b["repeat"], strict=True):
                if k != job:
                    job, pending = k, 0
                pending += bool(pending or not repeat)
                out.append(pending >= batch)
                pending = 0 if out[-1] else pending
            yield b.assign(flush=out)[[*names, "flush"]]

    if batch == 1:
        return df.withColumn("flush", ~F.col("repeat"))
    told = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    rows = df.withColumn("__job", told).repartition("__job").sortWithinPartitions("__job", *order)
    return rows.mapInPandas(fold, df.schema.add("flush", "boolean"))


def recognize_jobs(df: DataFrame, keys: list[str], order: list[str], sources: list[str], read: Callable[[str], Recognizer], review_by: Callable[[str], Recognizer] | None = None, language: str = "ch", retry: bool = False, batch: int = 1, name: str = "job") -> DataFrame:
    """text, reviewed and engine_language of rows with island and repeat: all that a job does between frames and samples.

    Rows that don't repeat are read from the first of sources; with ``retry``, empty ones from the later sources; doubtful texts a
    second time by review_by. Repeats take what their island's first row got. After the first batch of readings
    that leaves the last rows mostly English, the readers are the English ones: such rows are read again, and no others.
    read and review_by get a language and return a recognizer. The first phase is written to the shared folder.
    """
    def phase(rows: DataFrame, language: str) -> DataFrame:
        out = recognize_with_retry(rows, sources, name, partial(read, language), retry, language=language)
        if review_by is None:
            return out.withColumn("reviewed", F.lit(False))
        return review(out, "text", sources[0], f"{name}-review", partial(review_by, language), language=language)

    def carried(anchors: DataFrame, repeats: DataFrame) -> DataFrame:
        told = F.struct("text", "reviewed", "engine_language")
        all_ = scan.whole(anchors.unionByName(repeats, allowMissingColumns=True))
        rows = scan.first_of_run(all_, keys, order, "island", told, "__told").drop(scan.CUTS)
        return rows.withColumns({c: F.when(F.col("repeat"), F.col(f"__told.{c}")).otherwise(F.col(c)) for c in ("text", "reviewed", "engine_language")}).drop("__told")

    first = staged(phase(df.where("not repeat"), language), "first-phase").withColumn("engine_language", F.lit(language))
    repeats = df.where("repeat")
    if language == "en":
        return carried(first, repeats)
    seen = carried(first, repeats).select(*keys, *order, "repeat", "island", "text")
    marked = english_window(scan.segmented(flush_rows(seen, keys, order, batch), keys, order), keys, order, "text")
    ever = scan.running(marked.withColumn("__now", F.col("english") & F.col("flush")), keys, order, {"__ever": ("max", F.col("__now").cast("int"))}, "before")
    at = ever.where("not repeat and __ever = 1").select(*[F.col(c).alias(f"__{c}") for c in [*keys, *order]])
    same = [first[c].eqNullSafe(at[f"__{c}"]) for c in [*keys, *order]]
    told = first.join(at.withColumn("__changed", F.lit(True)), same, "left").drop(*at.columns)
    changed = told.where("__changed").drop("__changed", "text", "reviewed", "engine_language")
    anchors = told.where("__changed is null").drop("__changed").unionByName(phase(changed, "en").withColumn("engine_language", F.lit("en")))
    return carried(anchors, repeats)


def correction_requests(cues: DataFrame, keys: list[str], size: int = 40) -> DataFrame:
    """(keys, chunk, request): each block of cues as the JSON that a corrector gets."""
    rows = chunked(cues, keys, ["start"], size)
    items = F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: F.struct(x.i.alias("i"), x.text.alias("text")))
    return rows.groupBy(*keys, "chunk").agg(F.to_json(F.struct(items.alias("items"))).alias("request"))


def apply_corrections(cues: DataFrame, corrections: DataFrame, keys: list[str], size: int = 40) -> DataFrame:
    """cues with the texts that corrections (keys, chunk, found MAP<INT, STRING>) give; times never change. A null key is a job like any other."""
    rows = chunked(cues, keys, ["start"], size)
    named = corrections.select(*[F.col(k).alias(f"__{k}") for k in [*keys, "chunk"]], "found")
    joined = rows.join(named, [rows[k].eqNullSafe(named[f"__{k}"]) for k in [*keys, "chunk"]], "left")
    return joined.withColumn("text", F.coalesce(F.try_element_at("found", F.col("i")), F.col("text"))).drop("found", "chunk", "i", *[f"__{k}" for k in [*keys, "chunk"]])


def correct(cues: DataFrame, keys: list[str], client: Callable[[str], str] | None, size: int = 40, replies_path: str | None = None) -> DataFrame:
    """Cues corrected by a client from a block's JSON to a reply. No client: unchanged. A failing block: unchanged.

    replies_path: a store of replies in a shared folder, which later calls read and add to, so that no block is asked twice; without
    it a new one in the shared folder.
    """
    if client is None:
        return cues
    requests = staged(correction_requests(cues, keys, size).withColumn("request_key", asking.request_key(F.lit(""), F.col("request"))), "requests")
    told = asking.answered(requests.select("request_key", F.lit("").alias("url"), F.col("request").alias("body")), lambda _, body: client(body), replies_path or new_path(cues.sparkSession, "replies"))
    found = requests.join(told.where("error is null"), "request_key").select(*keys, "chunk", correction_map(F.col("reply")).alias("found"))
    return apply_corrections(cues, found, keys, size)


def correct_by_service(cues: DataFrame, keys: list[str], client: asking.Client | None, replies_path: str, provider: Column, model: Column | None = None, url: Column | None = None, has_key: bool = True, size: int = 40, waves: int = 4) -> DataFrame:
    """Cues corrected over one of three wire formats, provider a Column of correction_requests' keys or a literal.

    client: from an address and a body to the answer's body. Without a client or, but for local services, a key, and for every
    block whose answer is an error or no map of corrections, cues stay as they are.
    """
    if client is None:
        return cues
    none = F.lit(None).cast("string")
    bodies = asking.wire_requests(correction_requests(cues, keys, size), provider_name(provider), none if model is None else model, none if url is None else url)
    told = asking.replies(bodies if has_key else bodies.where("provider = 'ollama'"), client, replies_path, waves)
    return apply_corrections(cues, told.where("text is not null").select(*keys, "chunk", correction_map(F.col("text")).alias("found")), keys, size)
