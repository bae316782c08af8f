"""DuckDB SQL that says what the catalog's queries say, over the same tables."""

from __future__ import annotations

from cuelake.functions.config import BASE_URLS, ENGINE_ORDER, MODELS, PROVIDERS
from cuelake.functions.text import CJK, GLUE_MARKERS, NORMALIZE_DELETES, PUNCTUATION, REPAIRS, TRIM_CHARS, in_class
from cuelake.operators.asking import INSTRUCTION, MOST_TOKENS, PATHS, TASK

FPS = "1.5"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LINES = f"""lines AS (SELECT doc_id, lang, CAST(i - 1 AS BIGINT) AS pos, (i - 1) / {FPS}::DOUBLE AS ts, parts[i] AS line
  FROM (SELECT doc_id, lang, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d, unnest(range(1, len(parts) + 1)) u(i))"""
MASKS = """masks AS (SELECT vec_id % 8 AS job, vec_id, list_filter(range(len(embedding)), lambda i: embedding[i + 1] > 0) AS s FROM embeddings)"""
JOBS = """jobs AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'running' END AS status,
  o_totalprice % 1 AS progress, o_orderpriority AS phase, o_orderdate AS created_at FROM orders)"""
DIFFS = MASKS + """, lagged AS (SELECT job, vec_id, s, lag(s) OVER (PARTITION BY job ORDER BY vec_id) AS b FROM masks),
 diffs AS (SELECT job, vec_id, CASE WHEN b IS NULL THEN NULL WHEN len(list_distinct(list_concat(s, b))) = 0 THEN 0.0
  ELSE 1 - len(list_intersect(s, b))::DOUBLE / len(list_distinct(list_concat(s, b))) END AS diff FROM lagged)"""
ISLANDS = DIFFS + """, flagged AS (SELECT *, coalesce(diff <= 0.6, false) AS repeat FROM diffs),
 islands AS (SELECT *, CAST(sum((NOT repeat)::INT) OVER (PARTITION BY job ORDER BY vec_id) AS BIGINT) AS island FROM flagged)"""


def squeezed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def clean(x: str) -> str:
    t = f"trim({squeezed(x)}, {quoted(TRIM_CHARS)})"
    return f"CASE WHEN {x} <> '' AND length({t}) >= 2 AND {real_share(t)} >= 0.55 THEN {t} END"


def real_share(x: str) -> str:
    return rf"length(regexp_replace({x}, {quoted('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + in_class(PUNCTUATION) + ']')}, '', 'g'))::DOUBLE / greatest(length({x}), 1)"


def norm(x: str) -> str:
    deletes = "".join(c for c in NORMALIZE_DELETES if c not in "\t\r\n")
    return f"translate(lower({x}), {quoted(deletes)} || chr(9) || chr(13) || chr(10), '')"


def n_of(x: str, keep: str) -> str:
    return f"length(regexp_replace({x}, '[^{keep}]', '', 'g'))"


def v(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g')"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[A-Za-z]+')"


MARKS = "[.?!,:;]"


def caps_code(x: str) -> str:
    k = f"regexp_replace({x}, '[^A-Za-z0-9]', '', 'g')"
    return f"(NOT regexp_matches({k}, '[a-z]') AND ((length({k}) BETWEEN 2 AND 10 AND regexp_matches({k}, '[0-9]')) OR (length({k}) BETWEEN 2 AND 5 AND NOT regexp_matches({x}, '{MARKS}'))))"


def noise(x: str) -> str:
    s = v(x)
    k, t = f"regexp_replace({s}, '[^A-Za-z0-9]', '', 'g')", f"regexp_extract_all({s}, '[A-Za-z0-9]+')"
    one = f"(len({t}) = 1 AND length({k}) BETWEEN 4 AND 12 AND (({n_of(k, 'A-Z')} >= 3 AND regexp_matches({k}, '[a-z]')) OR upper({k}) = 'TODAUT'))"
    row = f"(len({t}) BETWEEN 4 AND 12 AND NOT regexp_matches({k}, '[a-z]') AND regexp_matches({k}, '[0-9]') AND len(list_filter({t}, lambda w: length(w) <= 3)) >= 0.75 * len({t}))"
    return f"({s} <> '' AND (length({s}) <= 2 OR regexp_matches({k}, '^[0-9]+$') OR {caps_code(s)} OR {one} OR {row}))"


def unspaced(x: str) -> str:
    w, k = words(x), f"regexp_replace({x}, '[^A-Za-z]', '', 'g')"
    spaced = f"(contains({x}, ' ') AND len(list_filter(string_split({squeezed(x)}, ' '), lambda w: w <> '')) >= len({w}))"
    return f"(len({w}) BETWEEN 1 AND 4 AND length({k}) >= 12 AND {n_of(k, 'A-Z')} >= 0.85 * length({k}) AND NOT {spaced} AND len(list_filter({w}, lambda w: length(w) >= 7)) > 0)"


def glued(x: str) -> str:
    k = f"regexp_replace({x}, '[^A-Za-z'']', '', 'g')"
    return f"(length({k}) >= 12 AND (regexp_matches(lower({k}), '{'|'.join(GLUE_MARKERS)}') OR (regexp_matches({k}, '[a-z][A-Z]') AND len(list_filter({words(x)}, lambda w: length(w) >= 13)) > 0)))"


def mixed(x: str) -> str:
    return f"(regexp_matches({x}, '{CJK}') AND {n_of(x, 'A-Za-z')} >= 2)"


def review(x: str) -> str:
    s = v(x)
    w = words(s)
    return f"(length({s}) <= 2 OR {caps_code(s)} OR (len({w}) = 1 AND {n_of(s, 'A-Za-z')} >= 18) OR (len({w}) >= 2 AND ({unspaced(s)} OR {glued(s)} OR {n_of(s, 'A-Za-z')} >= 14 * len({w}))) OR {mixed(s)})"


def safe(x: str) -> str:
    return rf"({v(x)} <> '' AND length({v(x)}) <= 500 AND NOT regexp_matches({v(x)}, '[\r\n]'))"


def prefers(p: str, r: str) -> str:
    return f"({v(r)} <> '' AND NOT {noise(r)} AND ({v(p)} = '' OR ({review(p)} AND (NOT {review(r)} OR length({v(r)}) > 1.25 * length({v(p)})))))"


def accepts(x: str, score: str) -> str:
    s = v(x)
    w = words(s)
    return f"(coalesce({score} >= 0.82, true) AND length({s}) > 1 AND (length({s}) > 3 OR regexp_matches({s}, '{MARKS}')) AND NOT {caps_code(s)} AND NOT (len({w}) = 1 AND length({w}[1]) <= 6 AND NOT regexp_matches({s}, '{MARKS}')) AND NOT {mixed(s)})"


LINES_TOTAL = f"WITH {LINES} SELECT lang, count(*) AS n_lines, count_if(line = '')::BIGINT AS n_blank, sum(length(line))::BIGINT AS n_chars FROM lines GROUP BY lang"
LINE_CLEAN = f"WITH {LINES}, c AS (SELECT doc_id, pos, {clean('line')} AS clean FROM lines) SELECT *, {norm('clean')} AS norm FROM c"
LINE_REAL_SHARE = f"WITH {LINES} SELECT doc_id, pos, round({real_share('line')}, 6) AS share FROM lines"
LINE_FLAGS = f"WITH {LINES} SELECT doc_id, pos, {noise('line')} AS noise, {review('line')} AS review, {unspaced('line')} AS unspaced, {glued('line')} AS glued, {safe('line')} AS safe FROM lines"
LINE_ACCEPT = f"WITH {LINES}, s AS (SELECT *, CASE WHEN pos % 5 <> 0 THEN 0.7::DOUBLE + (pos % 4) / 10::DOUBLE END AS score FROM lines) SELECT doc_id, pos, {accepts('line', 'score')} AS accepted FROM s"
WORD_SHAPES = f"WITH {LINES}, w AS (SELECT lang, unnest(regexp_extract_all(line, '[A-Za-z0-9]+')) AS w FROM lines) SELECT lang, count(*) AS n, count_if({noise('w')})::BIGINT AS noise, count_if({review('w')})::BIGINT AS review FROM w GROUP BY lang"
REVIEW_CHOICE = f"WITH {LINES}, s AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS second FROM lines) SELECT doc_id, pos, {prefers('line', 'second')} AS second_wins FROM s"


WORD, SPACE = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}", r"\s\x{0b}\x{85}\p{Z}"


def bounded(p: str) -> str:
    """A pattern between word boundaries, which RE2 knows for ASCII only: what stands around is taken along."""
    return f"(^|[^{WORD}])(?:{p})($|[^{WORD}])"


def _repair() -> str:
    x = v("line")
    for p, r in REPAIRS:
        for _ in range(2):  # neighbours share what stands between them
            x = f"regexp_replace({x}, {quoted(bounded(p))}, {quoted(chr(92) + '1' + r + chr(92) + '2')}, 'gi')"
    for _ in range(2):
        x = rf"regexp_replace({x}, ',([^{SPACE}])', ', \1', 'g')"
    x = rf"regexp_replace({x}, '\.{{2,}}$', '.')"
    x = rf"regexp_replace({x}, '^G Plug-in($|[^{WORD}])', 'MG Plug-in\1')"
    return rf"regexp_replace({x}, '^ah[{SPACE}]+\.[^{SPACE}]+[{SPACE}]+', '', 'i')"


REPAIR = rf"""WITH {LINES}, r AS MATERIALIZED (SELECT doc_id, pos, line, CASE WHEN regexp_matches({v('line')}, {quoted(bounded('|'.join(p for p, _ in REPAIRS)) + f'|,[^{SPACE}]|[.][.]$|^G Plug-in|^[Aa][Hh]')}, 'i') THEN {_repair()} ELSE {v('line')} END AS x FROM lines)
SELECT doc_id, pos, CASE WHEN {v('line')} = '' OR {noise('line')} OR (regexp_matches(x, {quoted(bounded('technol'))}, 'i') AND regexp_matches(x, {quoted(bounded('ti+me'))}, 'i')) THEN ''
 WHEN len({words('x')}) >= 3 THEN {v(rf"regexp_replace(x, '[{SPACE}]+[0-9][{SPACE}]*$', '')")} ELSE x END AS fixed FROM r"""
ENGLISH_WINDOW = rf"""WITH {LINES}, s AS (SELECT doc_id, pos, {v('line')} AS t FROM lines), c AS (SELECT doc_id, pos, (t <> '')::INT AS f, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS l,
 {n_of('t', 'A-Za-zİK')} AS a, {n_of('t', '一-鿿')} AS k FROM s)
SELECT doc_id, pos, sum(f) OVER w >= 4 AND sum(l) OVER w >= 20 AND sum(a) OVER w >= 0.85 * sum(l) OVER w AND sum(k) OVER w <= 1 AS english FROM c
WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""
PREVIEWS = f"WITH p AS (SELECT doc_id, {squeezed(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 220 THEN t ELSE t[:219] || '...' END AS preview FROM p"
TAG_STRIP = "SELECT page_id, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS n, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS digest FROM pages"

MASK_DIFF = f"WITH {DIFFS} SELECT job, vec_id, round(diff, 9) AS diff FROM diffs"
REUSE_ISLANDS = f"WITH {ISLANDS} SELECT job, vec_id, repeat, island, first(vec_id) OVER (PARTITION BY job, island ORDER BY vec_id) AS anchor FROM islands"
BOOL_RUNS = """WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, event_type = 'error' AS o FROM events),
 q AS (SELECT *, place - row_number() OVER (PARTITION BY user_id ORDER BY place) AS run FROM p WHERE o)
SELECT user_id, min(place)::BIGINT AS start, (max(place) + 1)::BIGINT AS "end" FROM q GROUP BY user_id, run"""
EVEN_SAMPLE = f"""WITH {LINES}, p AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS place, count(*) OVER (PARTITION BY doc_id) AS n FROM lines)
SELECT doc_id, pos FROM p WHERE n <= 14 OR list_contains(list_transform(range(14), lambda i: round_even(i * (n - 1) / 13::DOUBLE, 0)::BIGINT), place)"""
QUARTILE_LINES = f"""WITH {LINES}, p AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS place, count(*) OVER (PARTITION BY doc_id) AS n FROM lines)
SELECT doc_id, pos FROM p WHERE place IN (floor(n * 0.25)::BIGINT, floor(n * 0.5)::BIGINT, floor(n * 0.75)::BIGINT)"""
UPPER_MEDIAN = "WITH s AS (SELECT user_id, list_sort(list(value)) AS l FROM events WHERE value IS NOT NULL GROUP BY user_id) SELECT user_id, l[len(l) // 2 + 1] AS median FROM s"
UPLOAD_BUDGET = "WITH s AS (SELECT doc_id, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS received FROM documents) SELECT *, received <= 100000 AS accepted FROM s"
STREAM_PICK = """SELECT source, doc_id, lang FROM documents WHERE doc_id % 3 <> 0
QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE lower(lang) WHEN 'es' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END, doc_id) = 1"""
STREAM_PARSE = """SELECT doc_id, 0::BIGINT AS subtitle_index, '0:' || (doc_id % 4) AS stream_id, 'subrip' AS codec, lang AS language FROM documents
UNION ALL SELECT doc_id, 1, '0:9', 'mov_text', NULL FROM documents"""


def stamp(x: str) -> str:
    ms = f"round_even(greatest({x}, 0) * 1000, 0)::BIGINT"
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} % 3600000 // 60000, {ms} % 60000 // 1000, {ms} % 1000)"


SAMPLES = f"{LINES}, samples AS (SELECT doc_id, pos, ts, {clean('line')} AS clean FROM lines), n AS (SELECT *, {norm('clean')} AS norm FROM samples)"
MERGE = """, j AS (SELECT *, CASE WHEN lag(nm) OVER w = nm AND start - lag("end") OVER w <= 0.5 THEN 0 ELSE 1 END AS opens FROM cue WINDOW w AS (PARTITION BY doc_id ORDER BY start)),
 k AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM j),
 merged AS (SELECT doc_id, arg_min(text, start) AS text, min(start) AS start, arg_max("end", start) AS "end" FROM k GROUP BY doc_id, run)"""
SESSIONS = f"""{SAMPLES}, a AS (SELECT *, lag(norm) OVER w AS pn, lag(clean) OVER w AS pc, CASE WHEN lead(clean) OVER w IS NULL THEN lead(ts) OVER w END AS closes FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY ts)),
 b AS (SELECT *, sum(CASE WHEN pc IS NOT NULL AND pn = norm AND norm <> '' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ts) AS session FROM a WHERE clean IS NOT NULL),
 cue AS (SELECT doc_id, arg_min(clean, ts) AS text, min(ts) AS start, max(greatest(ts + 1 / {FPS}::DOUBLE, coalesce(closes, 0))) AS "end", first(norm) AS nm FROM b GROUP BY doc_id, session){MERGE}"""
LINE_CUES = f"""{SAMPLES}, cue AS (SELECT doc_id, clean AS text, ts AS start, ts + 1 / {FPS}::DOUBLE AS "end", norm AS nm FROM n WHERE clean IS NOT NULL)"""
CUES_EXACT = f"""WITH {SESSIONS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS cue_no, {stamp('start')} AS start_ts, {stamp('"end"')} AS end_ts, text FROM merged"""
CUES_IDENTICAL = f"""WITH {LINE_CUES}{MERGE} SELECT doc_id, text, round(start, 6) AS start, round("end", 6) AS "end" FROM merged"""
CUES_CONTAINED = f"""WITH RECURSIVE {LINE_CUES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS i FROM cue),
 f AS (SELECT doc_id, i, i AS kept, nm AS knm, "end" AS kend FROM r WHERE i = 1 UNION ALL
  SELECT r.doc_id, r.i, CASE WHEN x.c THEN f.kept ELSE r.i END, CASE WHEN x.c THEN f.knm ELSE r.nm END, CASE WHEN x.c THEN greatest(f.kend, r."end") ELSE r."end" END
  FROM f JOIN r ON r.doc_id = f.doc_id AND r.i = f.i + 1, LATERAL (SELECT r.nm <> '' AND contains(f.knm, r.nm) AND length(r.nm) <= 0.8 * length(f.knm) AS c) x)
SELECT f.doc_id, any_value(r.text) AS text, round(any_value(r.start), 6) AS start, round(max(f.kend), 6) AS "end" FROM f JOIN r ON r.doc_id = f.doc_id AND r.i = f.kept GROUP BY f.doc_id, f.kept"""
FILES = f"""{SESSIONS}, num AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS cue_no FROM merged),
 files AS (SELECT doc_id, string_agg(cue_no || chr(10) || {stamp('start')} || ' --> ' || {stamp('"end"')} || chr(10) || text || chr(10), chr(10) ORDER BY start) AS srt, string_agg(text, chr(10) ORDER BY start) || chr(10) AS txt,
  list(text ORDER BY start) AS texts FROM num GROUP BY doc_id)"""
SRT_DOCUMENTS = f"WITH {FILES} SELECT doc_id, md5(srt) AS srt_md5, md5(txt) AS txt_md5 FROM files"
SRT_PLAIN = rf"""WITH {FILES}, kept AS (SELECT doc_id, list_filter(list_transform(texts, lambda t: regexp_replace(t, '<[^>]+>', '', 'g')), lambda t: t <> '' AND NOT regexp_matches(t, '^[0-9]+$') AND NOT contains(t, '-->')) AS l FROM files)
SELECT doc_id, md5(CASE WHEN len(l) = 0 THEN '' ELSE array_to_string(l, chr(10) || chr(10)) || chr(10) END) AS plain_md5 FROM kept"""
LLM_CHUNKS = f"WITH {SESSIONS}, num AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS n FROM merged) SELECT doc_id, n // 40 AS chunk, count(*) AS n, max(n % 40 + 1) AS last_i FROM num GROUP BY doc_id, n // 40"
LLM_APPLY = f"WITH {SESSIONS}, num AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS n FROM merged) SELECT doc_id, round(start, 6) AS start, CASE WHEN n % 40 + 1 = 2 THEN '> ' || text ELSE text END AS text FROM num"
LLM_PARSE = f"SELECT conv_id, turn, (turn > 0 AND {safe('text')})::BIGINT AS n, CASE WHEN turn > 0 AND {safe('text')} THEN {squeezed('text')} END AS fixed FROM conversations"

TIME_TEXTS = f"""WITH s AS (SELECT event_id, value * 37.5 AS s, round_even(greatest(value * 37.5, 0), 0)::BIGINT AS r, floor(greatest(value * 37.5, 0) + 0.5)::BIGINT AS u FROM events)
SELECT event_id, {stamp('s')} AS srt, CASE WHEN r < 60 THEN printf('%ds', r) WHEN r // 60 < 60 THEN printf('%dm %ds', r // 60, r % 60) ELSE printf('%dh %dm', r // 3600, r // 60 % 60) END AS duration, printf('%02d:%02d', u // 60, u % 60) AS clock FROM s"""
SIZE_TEXTS = """WITH s AS (SELECT o_orderkey, floor(o_totalprice * o_totalprice)::BIGINT AS b FROM orders), k AS (SELECT *, least(floor(log2(greatest(b, 1)) / 10), 3)::INT AS k FROM s)
SELECT o_orderkey, CASE WHEN b <= 0 THEN '0 B' ELSE CASE WHEN b / pow(1024.0, k) >= 10 OR k = 0 THEN printf('%.0f', b / pow(1024.0, k)) ELSE printf('%.1f', b / pow(1024.0, k)) END || ' ' || ['B', 'KB', 'MB', 'GB'][k + 1] END AS size FROM k"""
AGE_TEXTS = """WITH s AS (SELECT event_id, ts, (event_id * 137) % 4000000 AS s FROM events), m AS (SELECT *, floor(s / 60.0 + 0.5)::BIGINT AS m FROM s), h AS (SELECT *, floor(m / 60.0 + 0.5)::BIGINT AS h FROM m), d AS (SELECT *, floor(h / 24.0 + 0.5)::BIGINT AS d FROM h)
SELECT event_id, CASE WHEN s < 5 THEN 'just now' WHEN s < 60 THEN printf('%ds ago', s) WHEN m < 60 THEN printf('%dm ago', m) WHEN h < 24 THEN printf('%dh ago', h) WHEN d < 30 THEN printf('%dd ago', d) ELSE strftime(ts, '%Y-%m-%d') END AS age FROM d"""
CROP_BOXES = """WITH b AS (SELECT l_orderkey, l_linenumber, (trunc(l_quantity)::INT * 8 + 100) AS h, l_linenumber <> 7 AS has, l_discount AS x, l_tax AS y, l_quantity / 60 AS bw, l_quantity / 80 AS bh FROM lineitem),
 c AS (SELECT *, trunc(greatest(least(x, 1), 0) * 640)::BIGINT AS x0, trunc(greatest(least(x + bw, 1), 0) * 640)::BIGINT AS x1, trunc(greatest(least(y, 1), 0) * h)::BIGINT AS y0, trunc(greatest(least(y + bh, 1), 0) * h)::BIGINT AS y1 FROM b),
 d AS (SELECT *, has AND x1 > x0 AND y1 > y0 AS good FROM c)
SELECT l_orderkey, l_linenumber, CASE WHEN good THEN y0 ELSE h - greatest(1, trunc(h * 0.55::DOUBLE)::BIGINT) END AS top, CASE WHEN good THEN y1 ELSE h END::BIGINT AS bottom, CASE WHEN good THEN x0 ELSE 0 END::BIGINT AS "left", CASE WHEN good THEN x1 ELSE 640 END::BIGINT AS "right" FROM d"""
AUTO_CONFIG = """WITH v AS (SELECT o_orderkey, ['fast', 'balanced', 'accurate', 'balanced'][o_orderkey % 4 + 1] AS mode, o_totalprice / 100 AS d, (o_orderkey % 1000 + 300)::DOUBLE AS w, (o_custkey % 900 + 200)::DOUBLE AS h, CASE WHEN o_custkey % 3 = 0 THEN 0.62::DOUBLE END AS det FROM orders),
 p AS (SELECT *, h > 1.2 * w AS portrait FROM v),
 c AS (SELECT *, CASE mode WHEN 'fast' THEN CASE WHEN portrait THEN 0.45 ELSE 0.55 END WHEN 'accurate' THEN CASE WHEN portrait THEN 0.55 WHEN h <= 720 THEN 0.65 ELSE 0.60 END ELSE CASE WHEN portrait THEN 0.50 WHEN h <= 720 THEN 0.60 ELSE 0.55 END END::DOUBLE AS c0 FROM p),
 e AS (SELECT *, CASE WHEN w <= 960 AND NOT portrait THEN least(c0 + 0.05, 0.75) ELSE c0 END AS c1 FROM c)
SELECT o_orderkey, mode, CASE mode WHEN 'fast' THEN CASE WHEN d >= 1200 THEN 0.75 ELSE 1.0 END WHEN 'accurate' THEN CASE WHEN d <= 1200 THEN 2.0 ELSE 1.5 END ELSE CASE WHEN portrait OR d >= 1800 THEN 1.0 ELSE 1.5 END END::DOUBLE AS fps,
 round(CASE WHEN det > 0 THEN greatest(c1, least(det, CASE WHEN portrait THEN 0.58 ELSE 0.65 END)) ELSE c1 END, 6)::DOUBLE AS crop_bottom, CASE mode WHEN 'fast' THEN 0.76 WHEN 'accurate' THEN 0.68 ELSE 0.72 END::DOUBLE AS similarity, 4::BIGINT AS batch,
 CASE mode WHEN 'fast' THEN 0.40 WHEN 'accurate' THEN 0.16 ELSE 0.30 END::DOUBLE AS threshold FROM e"""
ENGINE_PLANS = f"""WITH o AS (SELECT o_orderkey AS k, list_filter([{', '.join(f"CASE WHEN o_orderkey // {2**i} % 2 = 1 THEN '{e}' END" for i, e in enumerate(ENGINE_ORDER))}], lambda e: e IS NOT NULL) AS a FROM orders),
 e AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'openvino' ELSE a[1] END AS engine FROM o)
SELECT k AS o_orderkey, engine, CASE WHEN engine IN ('openvino', 'onnxruntime') AND k % 3 <> 0 AND list_contains(a, 'paddle') THEN 'paddle' ELSE '' END AS review_engine FROM e"""
LANGUAGE_NAMES = "SELECT doc_id, CASE WHEN lower(lang) IN ('en', 'eng', 'english') THEN 'en' ELSE 'ch' END AS language, CASE WHEN doc_id % 2 = 0 THEN 'ollama' ELSE 'openai' END AS provider FROM documents"

RECENT_JOBS = f"WITH {JOBS} SELECT id, status, created_at FROM jobs ORDER BY created_at DESC, id DESC LIMIT 30"
RECOVERED_JOBS = f"WITH {JOBS} SELECT id, CASE WHEN status = 'done' THEN status ELSE 'failed' END AS status, CASE WHEN status = 'done' THEN phase ELSE 'failed' END AS phase, round(CASE WHEN status = 'done' THEN progress ELSE 1.0 END, 6) AS progress, CASE WHEN status <> 'done' THEN 'Server restarted while task was running.' END AS error FROM jobs"
CANCELED_JOBS = f"""WITH {JOBS} SELECT id, CASE WHEN id % 3 = 0 AND status = 'queued' THEN 'canceled' ELSE status END AS status,
 CASE WHEN id % 3 = 0 AND status = 'queued' THEN 'Task canceled' WHEN id % 3 = 0 AND status = 'running' THEN 'Cancel requested' ELSE 'ok' END AS message, id % 3 = 0 AND status IN ('queued', 'running') AS cancel_requested FROM jobs"""
PURGED_JOBS = f"WITH {JOBS} SELECT status, count(*) AS n FROM jobs WHERE status <> 'done' GROUP BY status"
LATEST_STATE = "SELECT user_id, arg_max(CASE WHEN event_id % 2 = 0 THEN event_type END, CASE WHEN event_id % 2 = 0 AND event_type IS NOT NULL THEN event_id END) AS event_type, arg_max(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 3 = 0 AND value IS NOT NULL THEN event_id END) AS value FROM events GROUP BY user_id"
PROGRESS = f"WITH {LINES} SELECT doc_id, pos, round(0.12 + 0.78 * row_number() OVER (PARTITION BY doc_id ORDER BY pos) / count(*) OVER (PARTITION BY doc_id)::DOUBLE, 9)::DOUBLE AS progress FROM lines"
LOG_SUMMARY = f"""WITH {ISLANDS} SELECT count(*) AS rows, count_if(NOT repeat)::BIGINT AS recognized, count_if(repeat)::BIGINT AS reused, count_if(vec_id % 7 = 0)::BIGINT AS reviewed, count_if(vec_id % 5 = 0)::BIGINT AS empty FROM islands"""
LOG_TAIL = "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 80"

REGIONS = """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN l_discount WHEN l_linenumber % 2 = 0 THEN l_tax END::DOUBLE AS x, CASE WHEN l_linenumber % 3 = 0 THEN 0.5 WHEN l_linenumber % 2 = 0 THEN 0.4 END::DOUBLE AS w,
 CASE WHEN l_linenumber % 3 = 0 THEN 'manual' WHEN l_linenumber % 2 = 0 THEN 'auto' END AS source FROM lineitem"""
DRAG_BOXES = """WITH b AS (SELECT l_orderkey, l_linenumber, l_discount::DOUBLE AS x1, l_tax::DOUBLE AS y1, l_quantity::DOUBLE / 60 AS x2, l_quantity::DOUBLE / 80 AS y2, l_quantity::DOUBLE * 10 + 100 AS fw, l_linenumber * 50.0 + 100 AS fh FROM lineitem),
 f AS (SELECT *, least(640 / fw, 360 / fh) AS s FROM b), g AS (SELECT *, (640 - fw * s) / 2 AS l, (360 - fh * s) / 2 AS t FROM f)
SELECT l_orderkey, l_linenumber, round(least(x1, x2), 6) AS x, round(least(y1, y2), 6) AS y, round(abs(x2 - x1), 6) AS w, round(abs(y2 - y1), 6) AS h, round(l, 6)::DOUBLE AS "left", round(t, 6)::DOUBLE AS top,
 round(greatest(least((300 - l) / (fw * s), 1), 0), 6)::DOUBLE AS px, round(greatest(least((200 - t) / (fh * s), 1), 0), 6)::DOUBLE AS py FROM g"""
REFINED_REGIONS = """WITH b AS (SELECT l_orderkey, l_linenumber, l_discount::DOUBLE * 8 AS y, l_quantity::DOUBLE / 60 AS h, l_tax::DOUBLE AS top, 1 - l_discount::DOUBLE * 4 AS bottom FROM lineitem), c AS (SELECT *, bottom - top AS a FROM b),
 d AS (SELECT *, least(greatest(0.1, 0.42 * a), least(0.24, a)) AS high, CASE WHEN a <= 0 OR y + h <= top OR y >= bottom THEN 1 WHEN a <= 0.72 AND (h >= 0.62 * a OR (y <= top + 0.18 * a AND h >= greatest(0.18, 0.5 * a))) THEN 2
  WHEN a <= 0.72 AND y + h < bottom - 0.12 * a THEN 3 WHEN h > 0.28 THEN 4 ELSE 1 END AS k FROM c)
SELECT l_orderkey, l_linenumber, round(CASE k WHEN 1 THEN y WHEN 2 THEN greatest(0, bottom - high) WHEN 3 THEN greatest(0, bottom - h) ELSE greatest(0, y + h / 2 - 0.14) END, 6)::DOUBLE AS y, round(CASE k WHEN 2 THEN high WHEN 4 THEN 0.28 ELSE h END, 6)::DOUBLE AS h FROM d"""
PROVIDER_SETTINGS = f"""WITH o AS (SELECT o_orderkey, [{', '.join(map(quoted, PROVIDERS))}][o_orderkey % 4 + 1] AS p, o_custkey % 2 = 0 AS named, o_custkey % 3 = 0 AS placed, CASE WHEN o_custkey % 5 = 0 THEN 'JSON mode is off' ELSE 'timeout' END AS said FROM orders),
 u AS (SELECT *, CASE WHEN placed THEN 'http://h/v1' ELSE MAP {{{', '.join(f"{quoted(k)}: {quoted(v)}" for k, v in BASE_URLS.items())}}}[p] END AS url FROM o)
SELECT o_orderkey, CASE WHEN named THEN 'm' ELSE MAP {{{', '.join(f"{quoted(k)}: {quoted(v)}" for k, v in MODELS.items())}}}[p] END AS model, url, url || '/chat' AS address, said LIKE 'JSON%' AS plain_retry FROM u"""
RESOURCE_PLANS = """WITH o AS (SELECT o_orderkey, o_orderkey % 32 + 1 AS c, (o_custkey % 64)::DOUBLE AS t, CASE WHEN o_custkey % 2 = 0 THEN (o_custkey % 64) * 0.7::DOUBLE END AS v FROM orders),
 p AS (SELECT *, least(greatest(c // 2, 4), 12) AS threads, CASE WHEN c >= 20 THEN 3 WHEN c >= 12 THEN 2 ELSE 1 END AS most, greatest(0, coalesce(v, t) - greatest(3.5, 0.15::DOUBLE * t)) AS usable FROM o)
SELECT o_orderkey, threads::INT AS cpu_threads, most::INT AS max_workers, greatest(1, least(most, greatest(1, c // greatest(4, least(threads, 8))), greatest(1, floor(usable / 4.5))))::INT AS worker_count FROM p"""
LOG_ROWS = f"""WITH {ISLANDS} SELECT vec_id, round_even(vec_id / 7::DOUBLE, 3) AS timestamp, CASE WHEN vec_id % 5 <> 0 THEN 'x' ELSE '' END AS text, vec_id % 5 = 0 AS empty, repeat AS reused, vec_id % 7 = 0 AS reviewed, CASE WHEN vec_id % 7 = 0 THEN 'paddle' END AS review_engine,
 round_even(diff, 5) AS diff FROM islands"""
ENGINE_LANGUAGES = f"""WITH e AS ({ENGLISH_WINDOW}) SELECT doc_id, pos, CASE WHEN coalesce(max(english::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'en' ELSE 'ch' END AS engine_language FROM e"""
CODEC_NAMES = """SELECT doc_id, doc_id % 4 IN (0, 2) AS is_text, doc_id % 4 IN (0, 2) AS is_video FROM documents"""
JOB_TEXTS = f"""WITH {JOBS}, s AS (SELECT *, id % 2 = 0 AS asked, CASE WHEN id % 3 = 0 THEN '' ELSE 'ok' END AS message FROM jobs)
SELECT id, CASE WHEN asked AND status NOT IN ('done', 'failed', 'canceled') THEN 'stopping' WHEN message <> '' THEN message ELSE coalesce(phase, '') END AS shown, '/jobs/' || id || '/output.srt' AS path FROM s"""
PURGE_TOTAL = f"WITH {JOBS} SELECT count_if(status = 'done')::BIGINT AS cleared FROM jobs"
PROGRESS_RATES = """WITH o AS (SELECT o_orderkey, o_orderkey % 100 AS d, greatest(o_custkey % 50, 0.001)::DOUBLE AS e FROM orders)
SELECT o_orderkey, round(d / e, 6) AS rate, round(CASE WHEN d > 0 THEN (100 - d) / (d / e) ELSE 0 END, 6)::DOUBLE AS remaining FROM o"""
REPLY_TEXTS = "SELECT conv_id, turn, coalesce(text, '') AS chat, coalesce(text, '') AS local, coalesce(text, '') AS blocks, coalesce(text, '') AS error FROM conversations"


def _wire() -> str:
    said = f"{quoted(TASK)} || request"
    both = f"[{{'role': 'system', 'content': {quoted(INSTRUCTION)}}}, {{'role': 'user', 'content': {said}}}]"
    body = {
        "blocks": f"{{'model': m, 'max_tokens': {MOST_TOKENS}, 'temperature': 0.0::DOUBLE, 'system': {quoted(INSTRUCTION)}, 'messages': [{{'role': 'user', 'content': {said}}}]}}",
        "local": f"{{'model': m, 'messages': {both}, 'stream': false, 'format': 'json', 'options': {{'temperature': 0}}}}",
        "chat": f"{{'model': m, 'messages': {both}, 'temperature': 0.0::DOUBLE, 'response_format': {{'type': 'json_object'}}}}",
        "plain": f"{{'model': m, 'messages': {both}, 'temperature': 0.0::DOUBLE}}",
    }
    case = lambda table: "CASE provider " + " ".join(f"WHEN {quoted(k)} THEN {quoted(x)}" for k, x in table.items()) + " END"
    return f"""WITH t AS (SELECT conv_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations),
 r AS (SELECT conv_id, n // 3 AS chunk, to_json({{'items': list({{'i': n % 3 + 1, 'text': text}} ORDER BY n)}})::VARCHAR AS request FROM t GROUP BY ALL),
 p AS (SELECT *, [{', '.join(map(quoted, PROVIDERS))}][conv_id % 4 + 1] AS provider FROM r),
 w AS (SELECT *, CASE WHEN conv_id % 3 = 0 THEN 'm' ELSE {case(MODELS)} END AS m,
  CASE WHEN conv_id % 5 = 0 THEN 'http://h/v1' ELSE {case(BASE_URLS)} END || CASE provider WHEN 'anthropic' THEN {quoted(PATHS['anthropic'])} WHEN 'ollama' THEN {quoted(PATHS['ollama'])} ELSE {quoted(PATHS['openai'])} END AS url FROM p),
 b AS (SELECT conv_id, chunk, provider, url, CASE provider WHEN 'anthropic' THEN to_json({body['blocks']})::VARCHAR WHEN 'ollama' THEN to_json({body['local']})::VARCHAR ELSE to_json({body['chat']})::VARCHAR END AS body,
  CASE WHEN provider NOT IN ('anthropic', 'ollama') THEN to_json({body['plain']})::VARCHAR END AS plain FROM w)
SELECT conv_id, chunk, provider, url, md5(body) AS body_md5, md5(plain) AS plain_md5, sha256(url || chr(10) || body) AS request_key FROM b"""


WIRE_BODIES = _wire()
SERVICE_CORRECTIONS = f"""SELECT conv_id, turn, CASE WHEN {safe("'> ' || coalesce(text, '')")} THEN {squeezed("'> ' || coalesce(text, '')")} ELSE coalesce(text, '') END AS text FROM conversations"""
SWITCHED_READINGS = f"""WITH {LINES}, e AS ({ENGLISH_WINDOW}), s AS (SELECT doc_id, pos, coalesce(max((english AND pos % 4 = 3)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS en FROM e)
SELECT doc_id, pos, CASE WHEN en THEN 'en' ELSE 'ch' END AS engine_language, md5(CASE WHEN en THEN 'en: ' ELSE '' END || line) AS text_md5 FROM s JOIN lines USING (doc_id, pos)"""
STORED_JOBS = """SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 55 = 0 THEN 'again' WHEN o_orderkey % 2 = 0 THEN 'done' WHEN o_orderkey % 3 = 0 THEN 'running' ELSE o_orderstatus END AS status, o_orderpriority AS phase,
 CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice % 1, 6) END AS progress FROM orders WHERE o_orderkey % 11 <> 0 OR o_orderkey % 55 = 0"""
LOG_LINES = """SELECT row_number() OVER (ORDER BY event_id) AS line, event_id % 7 = 0 AS bad, CASE WHEN event_id % 7 <> 0 THEN event_id END AS event_id, CASE WHEN event_id % 7 <> 0 THEN event_type || chr(8232) || 'x' END AS text FROM events"""
READING_ROWS = """WITH c AS (SELECT conv_id, turn, turn % 7 AS k, coalesce(text, '') AS t, role AS r FROM conversations),
 w AS (SELECT conv_id, turn, list_filter(CASE k WHEN 0 THEN [{'t': t, 's': 0.5::DOUBLE}, {'t': r, 's': 1.0}] WHEN 1 THEN [{'t': t, 's': 0.75::DOUBLE}] WHEN 2 THEN [{'t': t, 's': NULL::DOUBLE}, {'t': r, 's': NULL}]
  WHEN 3 THEN [{'t': t, 's': 0.25::DOUBLE}, {'t': r, 's': 0.5}] WHEN 6 THEN [{'t': r, 's': NULL::DOUBLE}] ELSE [] END, lambda x: regexp_matches(x.t, '\\S')) AS x FROM c)
SELECT conv_id, turn, i - 1 AS place, x[i].t AS text, x[i].s AS score FROM w, unnest(range(1, len(x) + 1)) u(i)"""
PAGE_TEXTS = """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN coalesce(text, '') || '|' || role || '|' || role || '|kept' WHEN 1 THEN role || '|' || coalesce(text, '') ELSE '' END AS texts FROM conversations"""


def _settings() -> str:
    m = lambda j, name: f"CASE WHEN json_extract_string({j}, '$.{name}') IS NULL OR json_extract_string({j}, '$.{name}') IN ('', 'false', '0') THEN '' ELSE json_extract_string({j}, '$.{name}') END"
    provider = lambda x: f"CASE WHEN lower(trim({x})) IN ({', '.join(map(quoted, PROVIDERS))}) THEN lower(trim({x})) ELSE 'openai' END"
    obj = lambda x: f"CASE WHEN json_valid({x}) THEN CASE WHEN json_type({x}) = 'OBJECT' THEN {x} ELSE '{{}}' END ELSE '{{}}' END"
    texts = ['{"llm":{"enabled":true,"provider":" Ollama","model":"m","api_key":"old"},"other":{"a":[1,2]}}', "[1,2]", "{broken", None, '{"llm":{"enabled":"","provider":"nobody","base_url":5,"api_key":"  "}}', '{"llm":[1],"other":1}', '{"llm":{"enabled":1,"model":null,"api_key":" k "}}']
    given = ['{"enabled":1,"api_key":" ","model":" x "}', '{"provider":"anthropic","api_key":"new"}', "null", '{"enabled":false,"base_url":"http://h "}']
    listed = lambda v: "[" + ", ".join("NULL" if x is None else quoted(x) for x in v) + "]"
    b = {"enabled": f"({m('l', 'enabled')}) <> ''", "provider": provider(m("l", "provider")), "model": m("l", "model"), "base_url": m("l", "base_url"), "api_key": m("l", "api_key")}
    p = {"enabled": f"({m('p', 'enabled')}) <> ''", "provider": provider(f"coalesce(nullif({m('p', 'provider')}, ''), before_provider)"), "model": f"trim({m('p', 'model')})", "base_url": f"trim({m('p', 'base_url')})", "api_key": f"coalesce(nullif(trim({m('p', 'api_key')}), ''), before_api_key)"}
    return f"""WITH o AS (SELECT o_orderkey, {listed(texts)}[o_orderkey % 7 + 1] AS c, {listed(given)}[o_orderkey % 4 + 1] AS q FROM orders),
 j AS (SELECT o_orderkey, coalesce({obj('c')}, '{{}}') AS c, coalesce({obj('q')}, '{{}}') AS p FROM o),
 l AS (SELECT *, CASE WHEN json_type(c, '$.llm') = 'OBJECT' THEN json_extract(c, '$.llm')::VARCHAR ELSE '{{}}' END AS l, list_filter(json_keys(c), lambda x: x <> 'llm') AS others FROM j),
 b AS (SELECT *, {', '.join(f'{x} AS before_{k}' for k, x in b.items())} FROM l),
 a AS (SELECT *, {', '.join(f'{x} AS after_{k}' for k, x in p.items())} FROM b)
SELECT o_orderkey, {', '.join(f'{w}_{k}' for w in ('before', 'after') for k in b)}, trim(before_api_key) <> '' AS before_has_api_key, trim(after_api_key) <> '' AS after_has_api_key, len(others) + 1 AS members, len(others) = 0 AS gone FROM a"""


CORRECTOR_SETTINGS = _settings()
VIDEO_FILES = """SELECT page_id, page_id % 3 = 0 OR regexp_matches(lower(url || ['.MP4', '.flv', '', '.ts'][page_id % 4 + 1]), '[.](mp4|mkv|mov|avi|webm|m4v|ts)$') AS is_video FROM pages"""
