"""Requests to paid services, asked once: a store of replies by content, and the bodies of three wire formats.

A request is known by the hash of its address and body. What the store has an answer to is left out by an anti-join, the
rest is asked in waves, each appended as a whole; so a second call asks nothing, and a run that broke off goes on after
its last full wave.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.functions.config import base_url, joined_url, model_name
from cuelake.functions.replies import error_text, reply_text, wants_plain_retry
from cuelake.staging import staged

REPLIES = "request_key string, reply string, error string"
INSTRUCTION = "You repair machine-read captions: spelling, spaces, punctuation. Keep language, meaning, order and names. Answer with JSON alone, without translating or explaining."
TASK = 'Repair each "text" and keep each "i". Answer as {"items":[{"i":1,"text":"..."}]}.\n'
# Fixed values of the services' interfaces.
PATHS = {"anthropic": "/v1/messages", "ollama": "/api/chat", "openai": "/chat/completions"}
MOST_TOKENS, VERSION = 4096, "2023-06-01"

Client = Callable[[str, str], str]


def request_key(url: Column, body: Column) -> Column:
    """What a request is known by."""
    return F.sha2(F.concat_ws("\n", url, body), 256)


def wire_requests(requests: DataFrame, provider: Column, model: Column, url: Column, instruction: str = INSTRUCTION, task: str = TASK) -> DataFrame:
    """requests (column request: the JSON of a block) with provider, url, body and plain_body.

    plain_body is the body without the JSON mode, for services that may not have it; null for the others. Credentials are
    in neither: a client adds the headers.
    """
    m, said = model_name(provider, model), F.concat(F.lit(task), "request")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    both = F.array(message("system", F.lit(instruction)), message("user", said)).alias("messages")
    plain = [m.alias("model"), both, F.lit(0.0).alias("temperature")]
    chat = F.to_json(F.struct(*plain, F.struct(F.lit("json_object").alias("type")).alias("response_format")))
    blocks = F.to_json(F.struct(m.alias("model"), F.lit(MOST_TOKENS).alias("max_tokens"), F.lit(0.0).alias("temperature"), F.lit(instruction).alias("system"), F.array(message("user", said)).alias("messages")))
    local = F.to_json(F.struct(m.alias("model"), both, F.lit(False).alias("stream"), F.lit("json").alias("format"), F.struct(F.lit(0).alias("temperature")).alias("options")))
    by = lambda a, o, other: F.when(provider == "anthropic", a).when(provider == "ollama", o).otherwise(other)
    path = by(*[F.lit(PATHS[k]) for k in ("anthropic", "ollama", "openai")])
    return requests.withColumns({"provider": provider, "url": joined_url(base_url(provider, url), path), "body": by(blocks, local, chat), "plain_body": by(F.lit(None).cast("string"), F.lit(None).cast("string"), F.to_json(F.struct(*plain)))})


def headers(provider: str, key: str = "") -> dict[str, str]:
    """What a client sends besides the body."""
    own = {"anthropic": {"x-api-key": key, "anthropic-version": VERSION}, "ollama": {}}.get(provider, {"Authorization": f"Bearer {key}"} if key else {})
    return {"Content-Type": "application/json"} | own


def stored(spark: SparkSession, path: str) -> DataFrame:
    """(request_key, reply, error) of a store, one row a key, answers before errors; a new store is empty."""
    spark.createDataFrame([], REPLIES).write.mode("ignore").parquet(path)
    told = F.struct("reply", "error")
    fresh = spark.read.option("listed", uuid.uuid4().hex)  # scans of one folder count as equal, so a plan would read an older listing again
    rows = fresh.schema(REPLIES).parquet(path).groupBy("request_key").agg(F.min_by(told, F.struct(F.col("error").isNotNull(), "reply", "error")).alias("told"))
    return rows.select("request_key", "told.reply", "told.error")


def answered(requests: DataFrame, client: Client, path: str, waves: int = 4, lasting: Column | None = None) -> DataFrame:
    """(request_key, reply, error) of requests (request_key, url, body), once a key.

    client gets url and body and returns the answer's body; what it raises is stored as the error. Requests whose error is stored are
    asked again, but for errors that ``lasting`` (over the column error) holds of. Null bodies are not asked. A task that Spark repeats may ask again what it had asked.
    requests is read twice: to see what is new, which is written to the shared folder for the waves, and to find its answers.
    """
    spark = requests.sparkSession

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, url, body in zip(b["request_key"], b["url"], b["body"], strict=True):
                try:
                    out.append((key, client(url, body), None))
                except Exception as e:  # noqa: BLE001  whatever a client raises is this request's error
                    out.append((key, None, str(e)[:500] or type(e).__name__))
            yield pd.DataFrame(out, columns=["request_key", "reply", "error"])

    there = stored(spark, path)
    known = there.where(F.col("error").isNull() if lasting is None else F.col("error").isNull() | lasting).select("request_key")
    new = requests.where("body is not null").select("request_key", "url", "body").dropDuplicates(["request_key"]).join(known, "request_key", "left_anti")
    new = staged(new.withColumn("wave", F.pmod(F.xxhash64("request_key"), F.lit(waves))), "new-requests")
    for r in new.select("wave").distinct().orderBy("wave").collect():  # no more than waves rows
        new.where(F.col("wave") == r.wave).drop("wave").mapInPandas(ask, REPLIES).write.mode("append").parquet(path)
    return stored(spark, path).join(requests.select("request_key").distinct(), "request_key", "left_semi")


def replies(requests: DataFrame, client: Client, path: str, waves: int = 4) -> DataFrame:
    """requests (as of wire_requests) with text, the answer's text or null, and error.

    A request that fails for its JSON mode, or gets no text in it, is asked once more by its plain body. The requests are written to the
    shared folder before each of the two rounds, so that their bodies are made once.
    """
    def told(rows: DataFrame, body: str, name: str) -> DataFrame:
        keyed = staged(rows.withColumn("request_key", request_key(F.col("url"), F.col(body))), "requests")
        got = answered(keyed.select("request_key", "url", F.col(body).alias("body")), client, path, waves, wants_plain_retry(F.col("error")))
        error = F.coalesce("error", F.nullif(error_text(F.col("reply")), F.lit("")))
        both = keyed.join(got, "request_key", "left").withColumn(f"{name}_error", error)
        return both.withColumn(f"{name}_text", F.when(F.col(f"{name}_error").isNull(), reply_text(F.col("provider"), F.col("reply")))).drop("request_key", "reply", "error")

    first = told(requests, "body", "__first")
    failed = F.coalesce(wants_plain_retry(F.col("__first_error")), F.coalesce("__first_text", F.lit("")) == "")
    second = told(first.withColumn("__plain", F.when(failed, F.col("plain_body"))), "__plain", "__second")
    final = F.col("__plain").isNotNull()
    return second.withColumns({
        "text": F.when(final, F.col("__second_text")).otherwise(F.col("__first_text")),
        "error": F.when(final, F.col("__second_error")).otherwise(F.col("__first_error")),
    }).drop("__plain", *[f"__{k}_{v}" for k in ("first", "second") for v in ("text", "error")])
