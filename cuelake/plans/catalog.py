"""The queries of the caption operators, each over whole tables, and the SQL that says the same."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.functions import config, geometry, readings, replies, text, timecode
from cuelake.operators import asking, cascade, cues, jobs, scan, sequence
from cuelake.plans import sql
from cuelake.sources import formats
from cuelake.sources.jobstore import JobStore
from cuelake.staging import new_path
from cuelake.tables import table

FPS = 1.5
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name, with its SQL where there is one."""
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return put


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a sample: doc_id, lang, pos, ts, line."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    return rows.select("doc_id", "lang", F.col("pos").cast("long").alias("pos"), (F.col("pos") / FPS).alias("ts"), "line")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dealt by document before they are cleaned, so that all tasks share that work in whatever few pieces the table is stored."""
    return cues.prepared(lines(spark, sf_dir).withColumnRenamed("line", "text").repartition("doc_id"))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as position sets of their positive parts, eight sequences by vec_id."""
    rows = table(spark, sf_dir, "embeddings")
    places = F.filter(F.transform("embedding", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    return rows.select((F.col("vec_id") % 8).alias("job"), "vec_id", places.alias("signature"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as samples."""
    return table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") / FPS).alias("ts"), "text")


def as_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as job records."""
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("running")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), (F.col("o_totalprice") % 1).alias("progress"), F.col("o_orderpriority").alias("phase"), F.lit("ok").alias("message"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("cancel_requested"), F.col("o_orderdate").alias("created_at"))


# --- text quality ------------------------------------------------------------------------------------------------


@query(sql.LINES_TOTAL)
def line_totals(spark, sf_dir):
    """Lines, blank lines and characters of each language."""
    return lines(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n_lines"), F.count_if(F.col("line") == "").alias("n_blank"), F.sum(F.length("line")).alias("n_chars"))


@query(sql.LINE_CLEAN)
def line_clean(spark, sf_dir):
    """Cleaned and compared forms of lines."""
    c = text.clean_text(F.col("line"))
    return lines(spark, sf_dir).select("doc_id", "pos", c.alias("clean"), text.normalize(c).alias("norm"))


@query(sql.LINE_REAL_SHARE)
def line_real_share(spark, sf_dir):
    """Share of real characters of lines."""
    return lines(spark, sf_dir).select("doc_id", "pos", F.round(text.real_share(F.col("line")), 6).alias("share"))


@query(sql.LINE_FLAGS)
def line_flags(spark, sf_dir):
    """Every text predicate on every line."""
    c = F.col("line")
    return lines(spark, sf_dir).select("doc_id", "pos", text.is_hard_noise(c).alias("noise"), text.needs_review(c).alias("review"), text.is_unspaced_uppercase(c).alias("unspaced"), text.is_glued_english(c).alias("glued"), text.is_safe_correction(c).alias("safe"))


@query(sql.LINE_ACCEPT)
def line_accept(spark, sf_dir):
    """Acceptance of lines as tokens with scores made from their places."""
    score = F.when(F.col("pos") % 5 != 0, 0.7 + F.col("pos") % 4 / 10)
    return lines(spark, sf_dir).select("doc_id", "pos", text.accepts_token(F.col("line"), score).alias("accepted"))


@query(sql.WORD_SHAPES)
def word_shapes(spark, sf_dir):
    """Words of lines as tokens: noise and review of single words, the hardest cases of the predicates; each different word is judged once a language."""
    w = lines(spark, sf_dir).select("lang", F.explode(text.tokens(F.col("line"))).alias("w")).where(F.col("w").isNotNull()).groupBy("lang", "w").agg(F.count("*").alias("n"))
    share = lambda held: F.sum(F.when(held, F.col("n")).otherwise(F.lit(0).cast("long")))
    return w.groupBy("lang").agg(F.sum("n").alias("n"), share(text.is_hard_noise(F.col("w"))).alias("noise"), share(text.needs_review(F.col("w"))).alias("review"))


@query(sql.REVIEW_CHOICE)
def review_choice(spark, sf_dir):
    """Each line against the next as its second reading."""
    w = sequence.ordered(["doc_id"], ["pos"])
    rows = lines(spark, sf_dir).withColumn("second", F.lead("line").over(w))
    return rows.select("doc_id", "pos", text.prefers_review(F.col("line"), F.col("second")).alias("second_wins"))


@query(sql.REPAIR)
def repair_lines(spark, sf_dir):
    """Repaired lines of all documents, of any language and letters."""
    return lines(spark, sf_dir).select("doc_id", "pos", text.repair(F.col("line")).alias("fixed"))


@query(sql.REPAIR)
def repair_all_lines(spark, sf_dir):
    """As repair_lines, which took a part of the lines once."""
    return repair_lines(spark, sf_dir)


@query(sql.ENGLISH_WINDOW)
def english_window(spark, sf_dir):
    """Whether the last twelve lines are mostly English."""
    return sequence.english_window(lines(spark, sf_dir), ["doc_id"], ["pos"], "line").select("doc_id", "pos", "english")


@query(sql.PREVIEWS)
def previews(spark, sf_dir):
    """Short forms of whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query(sql.TAG_STRIP)
def tag_strip(spark, sf_dir):
    """Pages without tags."""
    bare = text.strip_tags(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(bare).cast("long").alias("n"), F.md5(bare).alias("digest"))


# --- ordered streams ---------------------------------------------------------------------------------------------


@query(sql.MASK_DIFF)
def mask_diff(spark, sf_dir):
    """Distance of each mask to the one before."""
    rows = sequence.lag_distance(masks(spark, sf_dir), ["job"], ["vec_id"], "signature")
    return rows.select("job", "vec_id", F.round("diff", 9).alias("diff"))


@query(sql.REUSE_ISLANDS)
def reuse_islands(spark, sf_dir):
    """Islands of unchanged masks, each row with its anchor."""
    cut = scan.segmented(masks(spark, sf_dir), ["job"], ["vec_id"])
    rows = sequence.reuse_islands(sequence.lag_distance(cut, ["job"], ["vec_id"], "signature"), ["job"], ["vec_id"], "diff", 0.6)
    return sequence.carry_forward(rows, ["job"], ["vec_id"], "vec_id", "anchor").select("job", "vec_id", "repeat", "island", "anchor")


@query(sql.BOOL_RUNS)
def bool_runs(spark, sf_dir):
    """Runs of error events of each user."""
    events = table(spark, sf_dir, "events")
    return sequence.true_runs(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")


@query(sql.EVEN_SAMPLE)
def even_sample(spark, sf_dir):
    """Fourteen evenly spaced lines of each document."""
    return sequence.even_sample(lines(spark, sf_dir), ["doc_id"], ["pos"], 14).select("doc_id", "pos")


@query(sql.QUARTILE_LINES)
def quartile_lines(spark, sf_dir):
    """The lines at a quarter, half and three quarters of each document."""
    return sequence.at_shares(lines(spark, sf_dir), ["doc_id"], ["pos"]).select("doc_id", "pos")


@query(sql.UPPER_MEDIAN)
def upper_median(spark, sf_dir):
    """The upper median of each user's values."""
    return sequence.upper_median(table(spark, sf_dir, "events"), ["user_id"], "value")


@query(sql.UPLOAD_BUDGET)
def upload_budget(spark, sf_dir):
    """Running size of a source's documents against a limit."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("bytes"))
    return sequence.within_budget(docs, ["source"], ["doc_id"], "bytes", 100_000).select("doc_id", "received", "accepted")


@query(sql.STREAM_PICK)
def stream_pick(spark, sf_dir):
    """One document of each source, as a file's text stream, by the order of languages."""
    docs = table(spark, sf_dir, "documents")
    return sequence.pick_stream(docs, ["source"], "doc_id", F.col("doc_id") % 3 != 0, F.col("lang"), ["es", "de", "fr"]).select("source", "doc_id", "lang")


@query(sql.STREAM_PARSE)
def stream_parse(spark, sf_dir):
    """Subtitle streams of listings made from documents."""
    line = F.concat(F.lit("    Stream #0:"), (F.col("doc_id") % 4).cast("string"), F.lit("("), "lang", F.lit("): Subtitle: SubRip, default"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Input #0\n    Stream #0:0: Video: h264\n"), line, F.lit("\n    Stream #0:9: Subtitle: mov_text (text)\n")).alias("banner"))
    return formats.parse_banner(rows, ["doc_id"], "banner").select("doc_id", F.col("subtitle_index").cast("long").alias("subtitle_index"), "stream_id", "codec", "language")


# --- cues --------------------------------------------------------------------------------------------------------


def _exact(spark, sf_dir) -> DataFrame:
    return cues.merge_identical(cues.exact_sessions(samples(spark, sf_dir), ["doc_id"], FPS), ["doc_id"])


@query(sql.CUES_EXACT)
def cues_exact(spark, sf_dir):
    """Numbered cues of documents by exact equality, with caption times."""
    rows = sequence.numbered(_exact(spark, sf_dir), ["doc_id"], ["start"])
    return rows.select("doc_id", "cue_no", timecode.srt_timestamp(F.col("start")).alias("start_ts"), timecode.srt_timestamp(F.col("end")).alias("end_ts"), "text")


@query(sql.CUES_IDENTICAL)
def cues_identical(spark, sf_dir):
    """Lines as cues, identical neighbours merged."""
    rows = samples(spark, sf_dir).where("clean is not null")
    as_cues = rows.select("doc_id", F.col("clean").alias("text"), F.col("ts").alias("start"), (F.col("ts") + 1 / FPS).alias("end"))
    out = cues.merge_identical(as_cues, ["doc_id"])
    return out.select("doc_id", "text", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(sql.CUES_CONTAINED)
def cues_contained(spark, sf_dir):
    """Lines as cues, fragments of the cue before dropped."""
    rows = samples(spark, sf_dir).where("clean is not null")
    as_cues = rows.select("doc_id", F.col("clean").alias("text"), F.col("ts").alias("start"), (F.col("ts") + 1 / FPS).alias("end"))
    out = cues.drop_contained(as_cues, "doc_id")
    return out.select("doc_id", "text", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query()
def cues_fuzzy(spark, sf_dir):
    """All passes of cue building on conversations, by similarity."""
    return cues.build_cues(turns(spark, sf_dir), "conv_id", FPS)


@query()
def cues_fuzzy_documents(spark, sf_dir):
    """All passes of cue building on documents' lines, by similarity."""
    rows = lines(spark, sf_dir).select("doc_id", "ts", F.col("line").alias("text"))
    return cues.build_cues(rows, "doc_id", FPS)


@query(sql.SRT_DOCUMENTS)
def srt_documents(spark, sf_dir):
    """Digests of each document's caption and text files."""
    both = cues.caption_files(_exact(spark, sf_dir), ["doc_id"])
    return both.select("doc_id", F.md5("srt").alias("srt_md5"), F.md5("txt").alias("txt_md5"))


@query(sql.SRT_PLAIN)
def srt_plain(spark, sf_dir):
    """Caption files back as plain text."""
    both = cues.caption_files(_exact(spark, sf_dir), ["doc_id"])
    return cues.plain_text(both, ["doc_id"], "srt").select("doc_id", F.md5("plain").alias("plain_md5"))


@query()
def srt_round_trip(spark, sf_dir):
    """Cues written as caption files and read back, to the millisecond."""
    both = cues.caption_files(_exact(spark, sf_dir), ["doc_id"])
    return formats.read_captions(both, ["doc_id"], "srt")


@query(sql.LLM_CHUNKS)
def llm_chunks(spark, sf_dir):
    """Blocks of forty cues for a corrector."""
    rows = sequence.chunked(_exact(spark, sf_dir), ["doc_id"], ["start"])
    return rows.groupBy("doc_id", "chunk").agg(F.count("*").alias("n"), F.max("i").cast("long").alias("last_i"))


@query(sql.LLM_APPLY)
def llm_apply(spark, sf_dir):
    """Corrections of every block's second cue applied."""
    rows = _exact(spark, sf_dir)
    found = sequence.chunked(rows, ["doc_id"], ["start"]).where("i = 2").select("doc_id", "chunk", F.create_map(F.lit(2), F.concat(F.lit("> "), "text")).alias("found"))
    out = cascade.apply_corrections(rows, found, ["doc_id"])
    return out.select("doc_id", F.round("start", 6).alias("start"), "text")


@query(sql.LLM_PARSE)
def llm_parse(spark, sf_dir):
    """Correction maps of replies made from all conversation turns; turn 0 is no index of a reply and gives an empty map."""
    reply = F.concat(F.lit('```json\n{"items": ['), F.to_json(F.struct(F.col("turn").alias("i"), F.col("text").alias("text"))), F.lit("]}\n```"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", replies.correction_map(reply).alias("m"))
    return rows.select("conv_id", "turn", F.size("m").cast("long").alias("n"), F.try_element_at("m", F.col("turn").cast("int")).alias("fixed"))


@query(sql.LLM_PARSE)
def llm_parse_all(spark, sf_dir):
    """As llm_parse, which took a part of the turns once."""
    return llm_parse(spark, sf_dir)


def _turn_cues(spark, sf_dir) -> DataFrame:
    """Conversation turns as cues."""
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("double").alias("start"), F.coalesce("text", F.lit("")).alias("text"))


def _service() -> Column:
    """A provider for each conversation."""
    return F.element_at(F.array(*[F.lit(p) for p in config.PROVIDERS]), (F.col("conv_id") % 4 + 1).cast("int"))


@query(sql.WIRE_BODIES)
def wire_bodies(spark, sf_dir):
    """Addresses and bodies of correction requests in the services' formats."""
    blocks = cascade.correction_requests(_turn_cues(spark, sf_dir), ["conv_id"], 3)
    rows = asking.wire_requests(blocks, _service(), F.when(F.col("conv_id") % 3 == 0, F.lit("m")), F.when(F.col("conv_id") % 5 == 0, F.lit("http://h/v1/")))
    return rows.select("conv_id", "chunk", "provider", "url", F.md5("body").alias("body_md5"), F.md5("plain_body").alias("plain_md5"), asking.request_key(F.col("url"), F.col("body")).alias("request_key"))


def echo_service(url: str, body: str) -> str:
    """A service that puts a mark before each text, and knows no JSON mode for half of the requests."""
    asked = json.loads(body)
    said = asked["messages"][-1]["content"]
    if "response_format" in asked and len(said) % 2:
        return json.dumps({"error": {"message": "response_format is unsupported"}})
    items = json.loads(said[said.index("\n") + 1 :])["items"]
    reply = json.dumps({"items": [{"i": x["i"], "text": "> " + x["text"]} for x in items]})
    if url.endswith("/messages"):
        return json.dumps({"content": [{"type": "text", "text": reply}]})
    return json.dumps({"message": {"content": reply}} if url.endswith("/chat") else {"choices": [{"message": {"content": reply}}]})


@query(sql.SERVICE_CORRECTIONS)
def service_corrections(spark, sf_dir):
    """Conversation turns corrected over the wire formats, by a service that only marks them."""
    out = cascade.correct_by_service(_turn_cues(spark, sf_dir), ["conv_id"], echo_service, new_path(spark, "replies"), _service(), size=3)
    return out.select("conv_id", F.col("start").cast("long").alias("turn"), "text")


def _marks(language: str) -> cascade.Recognizer:
    """A reading that tells its language."""
    return lambda xs: [None if x is None else x if language == "ch" else f"{language}: {x}" for x in xs]


@query(sql.SWITCHED_READINGS)
def switched_readings(spark, sf_dir):
    """Lines read in blocks of four, in English from the block on after which the last lines are mostly English."""
    out = cascade.recognize_switching(lines(spark, sf_dir), ["doc_id"], ["pos"], "line", "marks", _marks, batch=4)
    return out.select("doc_id", "pos", "engine_language", F.md5("text").alias("text_md5"))


# --- times, boxes and settings -----------------------------------------------------------------------------------


@query(sql.TIME_TEXTS)
def time_texts(spark, sf_dir):
    """Every time format on event values."""
    s = F.col("value") * 37.5
    rows = table(spark, sf_dir, "events").select("event_id", s.alias("s"))
    return rows.select("event_id", timecode.srt_timestamp(F.col("s")).alias("srt"), timecode.duration_text(F.col("s")).alias("duration"), timecode.clock(F.col("s")).alias("clock"))


@query(sql.SIZE_TEXTS)
def size_texts(spark, sf_dir):
    """Sizes as text."""
    return table(spark, sf_dir, "orders").select("o_orderkey", timecode.size_text(F.floor(F.col("o_totalprice") * F.col("o_totalprice"))).alias("size"))


@query(sql.AGE_TEXTS)
def age_texts(spark, sf_dir):
    """Ages of events at a fixed time."""
    then = F.unix_timestamp("ts")
    return table(spark, sf_dir, "events").select("event_id", timecode.age_text(then, then + F.col("event_id") * 137 % 4_000_000).alias("age"))


@query(sql.CROP_BOXES)
def crop_boxes(spark, sf_dir):
    """Pixel bounds of boxes made from line items."""
    rows = table(spark, sf_dir, "lineitem")
    box = F.when(F.col("l_linenumber") != 7, geometry.region(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 60, F.col("l_quantity") / 80))
    cut = geometry.crop_box(F.col("l_quantity").cast("int") * 8 + 100, F.lit(640), box, F.lit(0.55))
    return rows.select("l_orderkey", "l_linenumber", cut["top"].cast("long").alias("top"), cut["bottom"].cast("long").alias("bottom"), cut["left"].cast("long").alias("left"), cut["right"].cast("long").alias("right"))


@query(sql.AUTO_CONFIG)
def auto_config(spark, sf_dir):
    """Settings of videos made from orders."""
    o = table(spark, sf_dir, "orders")
    mode = F.element_at(F.array(*[F.lit(x) for x in ("fast", "balanced", "accurate", "other")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    c = config.auto_config(mode, F.col("o_totalprice") / 100, (F.col("o_orderkey") % 1000 + 300).cast("double"), (F.col("o_custkey") % 900 + 200).cast("double"), F.when(F.col("o_custkey") % 3 == 0, F.lit(0.62)))
    return o.select("o_orderkey", c["mode"].alias("mode"), c["fps"].alias("fps"), F.round(c["crop_bottom"], 6).alias("crop_bottom"), c["similarity"].alias("similarity"), c["ocr_batch_size"].cast("long").alias("batch"), c["frame_diff_threshold"].alias("threshold"))


@query(sql.ENGINE_PLANS)
def engine_plans(spark, sf_dir):
    """Engine choices for sets of available engines."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    there = F.filter(F.array(*[F.when(F.floor(k / 2**i) % 2 == 1, F.lit(e)) for i, e in enumerate(config.ENGINE_ORDER)]), lambda e: e.isNotNull())
    plan = config.engine_plan(F.when(k % 7 == 0, F.lit(" OpenVINO ")).otherwise(F.lit("auto")), F.when(k % 3 == 0, F.lit("fast")).otherwise(F.lit("balanced")), there)
    return o.select("o_orderkey", plan["engine"].alias("engine"), plan["review_engine"].alias("review_engine"))


@query(sql.LANGUAGE_NAMES)
def language_names(spark, sf_dir):
    """Language codes and providers of names."""
    return table(spark, sf_dir, "documents").select("doc_id", config.language_code(F.upper("lang")).alias("language"), config.provider_name(F.when(F.col("doc_id") % 2 == 0, F.lit(" Ollama")).otherwise(F.col("lang"))).alias("provider"))


def _box_rows(spark, sf_dir) -> DataFrame:
    """Line items as parts of boxes."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(f"l_{c}").cast("double").alias(c) for c in ("discount", "tax", "quantity")])


@query(sql.REGIONS)
def regions(spark, sf_dir):
    """The box that counts of a manual and a found one, and which it is."""
    manual = F.when(F.col("l_linenumber") % 3 == 0, geometry.region(F.col("discount"), F.col("tax"), F.lit(0.5), F.lit(0.25)))
    auto = F.when(F.col("l_linenumber") % 2 == 0, geometry.region(F.col("tax"), F.col("discount"), F.lit(0.4), F.lit(0.2)))
    box = geometry.active_region(manual, auto)
    return _box_rows(spark, sf_dir).select("l_orderkey", "l_linenumber", box["x"].alias("x"), box["w"].alias("w"), geometry.region_source(manual, auto).alias("source"))


@query(sql.DRAG_BOXES)
def drag_boxes(spark, sf_dir):
    """Dragged boxes, fitted pictures and pointers in them."""
    q = F.col("quantity")
    box = geometry.drag_box(F.col("discount"), F.col("tax"), q / 60, q / 80)
    fit = geometry.fitted(q * 10 + 100, F.col("l_linenumber") * 50.0 + 100, F.lit(640), F.lit(360))
    point = geometry.point_in(F.lit(300.0), F.lit(200.0), fit)
    told = {c: box[c] for c in "xywh"} | {"left": fit["left"], "top": fit["top"], "px": point["x"], "py": point["y"]}
    return _box_rows(spark, sf_dir).select("l_orderkey", "l_linenumber", *[F.round(v, 6).alias(c) for c, v in told.items()])


@query(sql.REFINED_REGIONS)
def refined_regions(spark, sf_dir):
    """Caption bands fitted to active rows."""
    got = geometry.refine_region(F.col("discount") * 8, F.col("quantity") / 60, F.col("tax"), 1 - F.col("discount") * 4, F.lit(0.1))
    return _box_rows(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(got["y"], 6).alias("y"), F.round(got["h"], 6).alias("h"))


@query(sql.PROVIDER_SETTINGS)
def provider_settings(spark, sf_dir):
    """Models and addresses of providers, and which errors ask for a plain retry."""
    c = F.col("o_custkey")
    provider = F.element_at(F.array(*[F.lit(p) for p in config.PROVIDERS]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    url = config.base_url(provider, F.when(c % 3 == 0, F.lit(" http://h/v1//")))
    said = F.when(c % 5 == 0, F.lit("JSON mode is off")).otherwise(F.lit("timeout"))
    return table(spark, sf_dir, "orders").select("o_orderkey", config.model_name(provider, F.when(c % 2 == 0, F.lit(" m "))).alias("model"), url.alias("url"), config.joined_url(url, F.lit("/chat")).alias("address"), replies.wants_plain_retry(said).alias("plain_retry"))


@query(sql.RESOURCE_PLANS)
def resource_plans(spark, sf_dir):
    """Threads and workers of machines."""
    total = (F.col("o_custkey") % 64).cast("double")
    plan = config.resource_plan(F.col("o_orderkey") % 32 + 1, total, F.when(F.col("o_custkey") % 2 == 0, total * 0.7))
    return table(spark, sf_dir, "orders").select("o_orderkey", *[plan[c].alias(c) for c in ("cpu_threads", "max_workers", "worker_count")])


@query(sql.CODEC_NAMES)
def codec_names(spark, sf_dir):
    """Text codecs and video names."""
    pick = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % 4 + 1).cast("int"))
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), pick(".MP4", ".txt", ".mkv", ".ts.bak"))
    return table(spark, sf_dir, "documents").select("doc_id", config.is_text_codec(pick("SubRip", "hdmv_pgs", "mov_text", "dvd_subtitle")).alias("is_text"), config.is_video_name(name).alias("is_video"))


@query(sql.ENGINE_LANGUAGES)
def engine_languages(spark, sf_dir):
    """The engine's language from the first mostly English window on."""
    return cascade.engine_languages(lines(spark, sf_dir), ["doc_id"], ["pos"], "line", F.lit("ch")).select("doc_id", "pos", "engine_language")


@query(sql.REPLY_TEXTS)
def reply_texts(spark, sf_dir):
    """Texts and errors in answers of the providers' shapes."""
    t = F.coalesce("text", F.lit(""))
    chat = F.to_json(F.struct(F.array(F.struct(F.struct(t.alias("content")).alias("message"))).alias("choices")))
    local = F.to_json(F.struct(F.struct(t.alias("content")).alias("message")))
    blocks = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), t.alias("text"))).alias("content")))
    error = F.to_json(F.struct(F.struct(t.alias("message")).alias("error")))
    said = lambda provider, body: replies.reply_text(F.lit(provider), body)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", said("openai", chat).alias("chat"), said("ollama", local).alias("local"), said("anthropic", blocks).alias("blocks"), replies.error_text(error).alias("error"))


# --- jobs and logs -----------------------------------------------------------------------------------------------


@query(sql.RECENT_JOBS)
def recent_jobs(spark, sf_dir):
    """The thirty newest jobs."""
    return jobs.recent(as_jobs(spark, sf_dir), "created_at", "id").select("id", "status", "created_at")


@query(sql.RECOVERED_JOBS)
def recovered_jobs(spark, sf_dir):
    """Jobs after a restart."""
    return jobs.recovered(as_jobs(spark, sf_dir)).select("id", "status", "phase", F.round("progress", 6).alias("progress"), "error")


@query(sql.CANCELED_JOBS)
def canceled_jobs(spark, sf_dir):
    """Jobs after a request to cancel every third."""
    return jobs.canceled(as_jobs(spark, sf_dir), F.col("id") % 3 == 0).select("id", "status", "message", "cancel_requested")


@query(sql.PURGED_JOBS)
def purged_jobs(spark, sf_dir):
    """What stays after a purge, by status."""
    return jobs.purged(as_jobs(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


@query(sql.LATEST_STATE)
def latest_state(spark, sf_dir):
    """The last value and type of each user's events."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"))
    return jobs.latest(events, "user_id", "event_id")


@query(sql.PROGRESS)
def progress(spark, sf_dir):
    """Progress of each line of a document."""
    return jobs.progress(lines(spark, sf_dir), ["doc_id"], ["pos"]).select("doc_id", "pos", F.round("progress", 9).alias("progress"))


@query(sql.LOG_SUMMARY)
def log_summary(spark, sf_dir):
    """Counts of a log made from masks."""
    cut = scan.segmented(masks(spark, sf_dir), ["job"], ["vec_id"])
    rows = sequence.reuse_islands(sequence.lag_distance(cut, ["job"], ["vec_id"], "signature"), ["job"], ["vec_id"], "diff", 0.6)
    log = rows.select(F.col("vec_id").cast("double").alias("timestamp"), F.when(F.col("vec_id") % 5 != 0, F.lit("x")).alias("text"), F.col("repeat").alias("reused"), (F.col("vec_id") % 7 == 0).alias("reviewed"), "diff")
    return jobs.log_summary(jobs.log_rows(log, {"review_engine": "paddle", "crop_bottom": 0.55}))


@query(sql.LOG_TAIL)
def log_tail(spark, sf_dir):
    """The last eighty events."""
    return jobs.log_tail(table(spark, sf_dir, "events"), "event_id").select("event_id", "event_type")


@query(sql.LOG_ROWS)
def log_rows(spark, sf_dir):
    """Log rows made from masks."""
    cut = scan.segmented(masks(spark, sf_dir), ["job"], ["vec_id"])
    rows = sequence.reuse_islands(sequence.lag_distance(cut, ["job"], ["vec_id"], "signature"), ["job"], ["vec_id"], "diff", 0.6)
    log = rows.select("vec_id", (F.col("vec_id") / 7).alias("timestamp"), F.when(F.col("vec_id") % 5 != 0, F.lit("x")).alias("text"), F.col("repeat").alias("reused"), (F.col("vec_id") % 7 == 0).alias("reviewed"), "diff")
    return jobs.log_rows(log, {"review_engine": "paddle", "crop_bottom": 0.55}).drop("crop_bottom", "crop_region", "crop_region_source")


@query(sql.JOB_TEXTS)
def job_texts(spark, sf_dir):
    """What jobs display, and where their captions lie."""
    rows = as_jobs(spark, sf_dir).withColumn("cancel_requested", F.col("id") % 2 == 0).withColumn("message", F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.lit("ok")))
    return rows.select("id", jobs.shown_message(rows).alias("shown"), jobs.artifact_path(F.concat(F.lit("/jobs/"), F.col("id").cast("string")), "srt").alias("path"))


@query(sql.PURGE_TOTAL)
def purge_total(spark, sf_dir):
    """How many jobs a purge clears."""
    return jobs.purge_count(as_jobs(spark, sf_dir))


@query(sql.PROGRESS_RATES)
def progress_rates(spark, sf_dir):
    """Rows a second and seconds left of jobs at work."""
    got = jobs.rates(F.col("o_orderkey") % 100, F.lit(100), (F.col("o_custkey") % 50).cast("double"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(got["rate"], 6).alias("rate"), F.round(got["remaining"], 6).alias("remaining"))


@query(sql.STORED_JOBS)
def stored_jobs(spark, sf_dir):
    """Orders written to a job store, changed, compacted, changed again and partly removed, as the store reads them."""
    store = JobStore(spark, new_path(spark, "jobs"), "id string, status string, phase string, progress double")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("phase"), "o_totalprice")
    store.write(o)
    store.write(o.where("o_orderkey % 3 = 0").select("id", F.lit("running").alias("status"), (F.col("o_totalprice") % 1).alias("progress")))
    store.compact()
    store.write(o.where("o_orderkey % 2 = 0").select("id", F.lit("done").alias("status"), F.lit(None).cast("string").alias("phase")))
    store.write(o.where("o_orderkey % 11 = 0"), removed=True)
    store.compact()
    store.write(o.where("o_orderkey % 55 = 0").select("id", F.lit("again").alias("status")))
    return store.jobs().select("id", "status", "phase", F.round("progress", 6).alias("progress"))


@query(sql.LOG_LINES)
def log_lines(spark, sf_dir):
    """Events written as a log of many files, its lines numbered over all of them, malformed ones kept."""
    path = new_path(spark, "log")
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).otherwise(F.to_json(F.struct(F.col("event_id").cast("double").alias("timestamp"), F.concat("event_type", F.lit("\u2028x")).alias("text")))).alias("value"))
    e.repartitionByRange(8, "event_id").sortWithinPartitions("event_id").select("value").write.option("lineSep", "\n").text(path)
    return formats.read_log(spark, path, by="name").select("line", "bad", F.col("row.timestamp").cast("long").alias("event_id"), F.col("row.text").alias("text"))


@query(sql.READING_ROWS)
def reading_rows(spark, sf_dir):
    """Tokens of recognizers' answers of seven shapes, made from conversation turns."""
    t, r, k = F.coalesce("text", F.lit("")), F.col("role"), F.col("turn") % 7
    quoted_text, quoted_role = (F.get(F.split(F.to_json(F.struct(c.alias("t"))), ":", 2), F.lit(1)) for c in (t, r))
    said, who = F.regexp_replace(quoted_text, r"\}$", ""), F.regexp_replace(quoted_role, r"\}$", "")
    shapes = [("[[[[0,0],[9,9]],", said, ",0.5],[[[1,1]],", who, ",1]]"), ("[[0,0],", said, ",0.75]"), ('{"txts":[', said, ',""," ",', who, "]}"), ('{"result":[],"res":[{"rec_text":', said, ',"confidence":0.25},{"txt":', who, ',"score":0,"rec_score":0.5},{"text":" "}]}'),
              ("{broken", said), ("null",), ('{"rec_texts":"no list","result":[[null,', who, ",null]]}")]
    answer = F.element_at(F.array(*[F.concat(*[F.lit(x) if isinstance(x, str) else x for x in shape]) for shape in shapes]), (k + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(readings.scored_rows(answer)).alias("place", "token"))
    return rows.select("conv_id", "turn", F.col("place").cast("long").alias("place"), F.col("token.text").alias("text"), F.col("token.score").alias("score"))


@query(sql.PAGE_TEXTS)
def page_texts(spark, sf_dir):
    """Texts of answers in pages, made from conversation turns."""
    t = F.coalesce("text", F.lit(""))
    deep = F.to_json(F.array(F.struct(F.array(t, "role").alias("rec_texts"), F.struct(F.array("role").alias("rec_texts")).alias("res")), F.struct(F.array(F.lit("kept")).alias("rec_texts"), F.lit(None).cast("struct<rec_texts:array<string>>").alias("res"))))
    flat = F.to_json(F.struct(F.struct(F.array("role", t).alias("rec_texts")).alias("res")))
    answer = F.when(F.col("turn") % 3 == 0, deep).when(F.col("turn") % 3 == 1, flat).otherwise(F.concat(F.lit("["), t))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(readings.page_texts(answer), "|").alias("texts"))


@query(sql.CORRECTOR_SETTINGS)
def corrector_settings(spark, sf_dir):
    """Settings read from texts that may be broken, and read again after a payload is saved and after a reset."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v) + 1).cast("int"))
    content = pick('{"llm":{"enabled":true,"provider":" Ollama","model":"m","api_key":"old"},"other":{"a":[1,2]}}', "[1,2]", "{broken", None, '{"llm":{"enabled":"","provider":"nobody","base_url":5,"api_key":"  "}}', '{"llm":[1],"other":1}', '{"llm":{"enabled":1,"model":null,"api_key":" k "}}')
    payload = pick('{"enabled":1,"api_key":" ","model":" x "}', '{"provider":"anthropic","api_key":"new"}', "null", '{"enabled":false,"base_url":"http://h "}')
    after = config.saved_settings(content, payload)
    told = {"before": config.corrector_settings(content), "after": config.corrector_settings(after)}
    fields = ["enabled", "provider", "model", "base_url", "has_api_key", "api_key"]
    rows = o.select("o_orderkey", *[v.alias(c) for c, v in told.items()], F.size(config.settings_object(after)).cast("long").alias("members"), config.reset_settings(content).isNull().alias("gone"))
    return rows.select("o_orderkey", *[F.col(c)[f].alias(f"{c}_{f}") for c in told for f in fields], "members", "gone")


@query(sql.VIDEO_FILES)
def video_files(spark, sf_dir):
    """Which picked files are videos, by type or name."""
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("page_id") % len(v) + 1).cast("int"))
    name = F.concat("url", pick(".MP4", ".flv", "", ".ts"))
    return table(spark, sf_dir, "pages").select("page_id", config.is_video_file(name, pick("video/x-flv", None, "text/html")).alias("is_video"))
