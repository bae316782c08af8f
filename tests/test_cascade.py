"""Asking once, wire formats, and two-phase recognition, against loops."""

import json
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cuelake.operators import asking, cascade

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have this file


def cues_of(spark, n=90, keys=("a", "b", None)):
    rows = [(k, float(i), i + 1.0, f"line {i} of {k}") for k in keys for i in range(n)]
    return spark.createDataFrame(rows, "job string, start double, end double, text string")


def logged(path, fail=lambda body: False):
    """A client that writes down what it is asked."""
    def client(url, body):
        with open(path, "a") as f:
            f.write(json.dumps([url, body]) + "\n")
        if fail(body):
            raise OSError("no answer")
        return json.dumps({"items": [{"i": x["i"], "text": x["text"].upper()} for x in json.loads(body)["items"]]})

    return client


def asked(path):
    return [json.loads(x) for x in open(path)] if path.exists() else []


def test_the_second_call_asks_nothing(spark, tmp_path):
    df, log, store = cues_of(spark), tmp_path / "log", str(tmp_path / "store")
    for _ in range(2):
        got = cascade.correct(df, ["job"], lambda r: logged(log)("", r), replies_path=store)
        assert sorted((r.job or "", r.start, r.text) for r in got.collect()) == sorted((r.job or "", r.start, r.text.upper()) for r in df.collect())
        assert len(asked(log)) == 9 == len({b for _, b in asked(log)})


def test_a_broken_run_goes_on(spark, tmp_path):
    log, store = tmp_path / "log", str(tmp_path / "store")
    rows = spark.createDataFrame([(f"u{k % 3}", json.dumps({"items": [{"i": 1, "text": f"t{k}"}]})) for k in range(40)] + [("u0", None)], "url string, body string")
    requests = rows.withColumn("request_key", asking.request_key(F.col("url"), F.col("body")))
    first = asking.answered(requests, logged(log, lambda b: '"t7"' in b), store).collect()
    assert len(first) == 40 and [r.error for r in first if r.error] == ["no answer"]
    again = asking.answered(requests.unionByName(requests), logged(log), store).collect()
    assert len(again) == 40 and not [r for r in again if r.error] and len(asked(log)) == 41

    def stops(url, body):
        raise SystemExit  # a worker that ends: the wave is lost, those before it stay

    more = requests.withColumn("request_key", F.concat("request_key", F.lit("x")))
    with pytest.raises(Exception):  # noqa: B017
        asking.answered(more, stops, store).collect()
    half = asking.answered(more.where("url = 'u1'"), logged(log), store).count()
    assert asking.answered(more, logged(log), store).count() == 40 and len(asked(log)) == 41 + 40 and half == len([k for k in range(40) if k % 3 == 1])


def service(log):
    """Answers in each format; knows no JSON mode for odd requests, has errors, and is silent in JSON mode for some."""
    def client(url, body):
        with open(log, "a") as f:
            f.write(json.dumps([url, body]) + "\n")
        got = json.loads(body)
        said = got["messages"][-1]["content"]
        items = json.loads(said[said.index("\n") + 1 :])["items"]
        reply = json.dumps({"items": [{"i": x["i"], "text": "* " + x["text"]} for x in items]})
        if "b_error" in said:
            return json.dumps({"error": {"message": "quota"}})
        if "response_format" in got and "c_mode" in said:
            raise ValueError("HTTP 400: JSON mode is not supported")
        if "response_format" in got and "d_silent" in said:
            return json.dumps({"choices": [{"message": {"content": ""}}]})
        if url.endswith("/v1/messages"):
            assert got["system"] and got["max_tokens"] == 4096 and len(got["messages"]) == 1
            return json.dumps({"content": [{"type": "text", "text": reply}]})
        if url.endswith("/api/chat"):
            assert got["format"] == "json" and got["stream"] is False
            return json.dumps({"message": {"content": reply}})
        return json.dumps({"choices": [{"message": {"content": [{"type": "text", "text": reply}]}}]})

    return client


@pytest.mark.parametrize("provider", ["openai", "anthropic", "ollama", "Other "])
def test_three_formats_and_the_plain_retry(spark, tmp_path, provider):
    log, store = tmp_path / "log", str(tmp_path / "store")
    df = cues_of(spark, 3, ("a_plain", "b_error", "c_mode", "d_silent", None))
    got = cascade.correct_by_service(df, ["job"], service(log), store, F.lit(provider))
    assert {(r.job, r.text) for r in got.collect()} == {(r.job, r.text if r.job == "b_error" else "* " + r.text) for r in df.collect()}
    chat = provider not in ("anthropic", "ollama")
    assert len(asked(log)) == (7 if chat else 5) and sum("response_format" in b for _, b in asked(log)) == (5 if chat else 0)
    cascade.correct_by_service(df, ["job"], service(log), store, F.lit(provider)).count()
    assert len(asked(log)) == (7 if chat else 5)  # errors in answers are answers


def test_without_a_key_or_client_nothing_changes(spark, tmp_path):
    df, log = cues_of(spark, 2), tmp_path / "log"
    assert cascade.correct_by_service(df, ["job"], None, "", F.lit("openai")) is df
    got = cascade.correct_by_service(df, ["job"], service(log), str(tmp_path / "s"), F.lit("openai"), has_key=False)
    assert sorted(r.text for r in got.collect()) == sorted(r.text for r in df.collect()) and not asked(log)
    assert asking.headers("anthropic", "k")["x-api-key"] == "k" and "Authorization" not in asking.headers("ollama", "k") and asking.headers("openai", "k")["Authorization"] == "Bearer k"


def readers(language):
    return lambda xs: [None if x is None else x if language == "ch" else f"{language}|{x}" for x in xs]


def english(texts):
    there = [t.strip() for t in texts if t and t.strip()]
    joined = " ".join(there)
    letters = sum(c.isalpha() for c in joined)
    return len(there) >= 4 and letters >= 20 and sum("a" <= c.lower() <= "z" for c in joined) >= 0.85 * letters and sum("一" <= c <= "鿿" for c in joined) <= 1


@pytest.mark.parametrize("batch", [1, 3, 8])
def test_switching_is_a_loop(spark, batch):
    rng = random.Random(batch)
    rows = []
    for job in ("a", "b", "c", None):
        since = rng.randint(5, 40)
        rows += [(job, k, rng.choice(["plain words are here", "more of them follow", None, ""]) if k >= since else rng.choice(["你好世界和平", "字幕", None])) for k in range(60)]
    want = {}
    for job in ("a", "b", "c", None):
        texts, language = [], "ch"
        some = [r for r in rows if r[0] == job]
        for at in range(0, len(some), batch):
            for _, k, x in some[at : at + batch]:
                t = readers(language)([x])[0]
                texts.append(t)
                want[job, k] = (t, language)
            if language == "ch" and len(texts) % batch == 0 and english(texts[-12:]):
                language = "en"
    df = spark.createDataFrame(rows, "job string, k int, image string").repartition(3)
    got = cascade.recognize_switching(df, ["job"], ["k"], "image", "r", readers, batch=batch)
    assert {(r.job, r.k): (r.text, r.engine_language) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "MapInPandas" in line)
    assert sum("MapInPandas" in line for line in plan) == 1 and any("Filter" in line and "__ever" in line for line in plan[at + 1 : at + 6])  # the second reader meets rows after the switch alone


def test_null_keys_and_one_source(spark):
    rows = [(None, 0, 0, False, "x"), (None, 1, 0, True, "y"), ("j", 0, 0, False, "z"), ("j", 1, 0, True, None)]
    df = spark.createDataFrame(rows, "job string, k int, island int, repeat boolean, image string")
    got = cascade.recognize_anchors(df, ["job"], ["k"], "image", "list", lambda: list)
    assert {(r.job, r.k): r.text for r in got.collect()} == {(None, 0): "x", (None, 1): "x", ("j", 0): "z", ("j", 1): "z"}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    crops = spark.createDataFrame([(0, "first"), (1, "")], "i int, a string")
    tried = cascade.recognize_with_retry(crops, ["a"], "list", lambda: list, False)
    assert {r.i: r.text for r in tried.collect()} == {0: "first", 1: ""}
    modes = spark.createDataFrame([("accurate",), ("manual",), ("fast",), (None,)], "mode string")
    assert [r.e for r in modes.select(cascade.retry_eligible(F.col("mode")).alias("e")).collect()] == [True, True, False, False]


def second(language):
    return lambda xs: [None if x is None else f"reviewed {language} words here" for x in xs]


def plain_job(rows, batch, retry):
    """One job's rows (k, repeat, island, a, b) by a loop that reads, retries, reviews, flushes and switches."""
    out, texts, pending, language, by_island = {}, [], [], "ch", {}

    def read(a, b):
        t = readers(language)([a])[0]
        if retry and not (t or "").strip() and b is not None:
            t = readers(language)([b])[0]
        if t is not None and ("thewordthatdefines" in t or len(t.strip()) <= 2):  # doubtful
            return second(language)([a])[0], True, language
        return t, False, language

    for k, repeat, island, a, b in rows:
        if repeat and not pending:
            out[k] = by_island.get(island, (None, None, None))
            texts.append(out[k][0])
            continue
        pending.append((k, repeat, island, a, b))
        if len(pending) >= batch:
            for k2, r2, i2, a2, b2 in pending:
                if not r2:
                    by_island[i2] = read(a2, b2)
                out[k2] = by_island[i2]
                texts.append(out[k2][0])
            pending = []
            if language == "ch" and english(texts[-12:]):
                language = "en"
    for k2, r2, i2, a2, b2 in pending:
        if not r2:
            by_island[i2] = read(a2, b2)
        out[k2] = by_island[i2]
    return out


@pytest.mark.parametrize(("batch", "retry"), [(1, False), (4, True)])
def test_whole_jobs_are_a_loop(spark, batch, retry):
    rng, rows, want = random.Random(batch), [], {}
    for job in ("a", "b", None):
        since, island, some = rng.randint(8, 20), 0, []
        for k in range(50):
            repeat = k > 0 and rng.random() < 0.4
            island += not repeat
            a = rng.choice(["plain words are here", "more of them follow", None, "", "thewordthatdefinesthelimits."]) if k >= since else rng.choice(["你好世界和平", "字幕说", None, ""])
            some.append((k, repeat, island, a, rng.choice([None, "other source of it"])))
        want |= {(job, k): v for k, v in plain_job(some, batch, retry).items()}
        rows += [(job, *r) for r in some]
    df = spark.createDataFrame(rows, "job string, k int, repeat boolean, island int, a string, b string").repartition(3)
    got = cascade.recognize_jobs(df, ["job"], ["k"], ["a", "b"], readers, second, retry=retry, batch=batch)
    assert {(r.job, r.k): (r.text, r.reviewed, r.engine_language) for r in got.collect()} == want
