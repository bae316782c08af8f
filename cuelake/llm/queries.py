"""The registered queries of the corpus operators: each applies one to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import bestfit, decontaminate, hmm, iblt, langid, packing, resample, secret_scan, simhash, substring, toxicity, vectors, warc
from cuelake.llm.common import new_path
from cuelake.tables import table


def op1_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and its edited text, and how alike they are."""
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document by the hidden Markov model and by word counts."""
    return hmm.language_scores(table(spark, sf_dir, "documents"), langid.held_out(10))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, read the archive back and report each record."""
    path = new_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    back = warc.read_archive(spark, path)
    return back.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to")


def tokenizer_path() -> str:
    """Where the public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens packed into windows of 4096."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the edits between them."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every document."""
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the 400-byte strings that stand elsewhere too."""
    out = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by profiles of those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    found = langid.profiles(docs.where(~langid.held_out(5)))
    out = langid.identify(docs, found)
    return out.select("doc_id", langid.held_out(5).alias("held_out"), "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a machine fitted on labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs.where(~langid.held_out(3, rest=1)), table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", langid.held_out(3, rest=1).alias("held_out"), "score", "predicted")


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in as few sequences of 2048 as best fit finds."""
    return bestfit.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings, with their errors and those of their labels."""
    return vectors.compressed(table(spark, sf_dir, "embeddings"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's texts, and which are drawn."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_iblt": op1_iblt,
    "op2_hmm": op2_hmm,
    "op3_warc": op3_warc,
    "op4_packing": op4_packing,
    "op5_decontaminate": op5_decontaminate,
    "op6_secret_scan": op6_secret_scan,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_langid": op8_langid,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_best_fit": op11_best_fit,
    "op12_vector_codes": op12_vector_codes,
    "op13_resample": op13_resample,
}


def _codes_sql(rounds: int = 4) -> str:
    """The product codes in SQL: distances of all parts to all entries, by inner products that are exact in doubles."""
    near = lambda k: f"SELECT p.vec_id, p.k, min((list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x))::BIGINT * 256 + b.e) AS found FROM p JOIN b{k} b USING (k) GROUP BY ALL"
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS MATERIALIZED (SELECT vec_id, label, k, v[k * len(v) // 4 + 1 : (k + 1) * len(v) // 4] AS x FROM v, range(4) r(k))",
        "b0 AS MATERIALIZED (SELECT * FROM (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS e, x FROM p) WHERE e < 256)",
    ]
    for k in range(rounds):
        steps += [
            f"a{k} AS MATERIALIZED ({near(k)})",
            f"m{k} AS (SELECT k, e, list(floor(s / n) ORDER BY i) AS x FROM (SELECT k, found % 256 AS e, i, sum(x[i]) AS s, count(*) AS n FROM p JOIN a{k} USING (vec_id, k), range(1, 1 + len(p.x)) r(i) GROUP BY ALL) GROUP BY k, e)",
            f"b{k + 1} AS MATERIALIZED (SELECT k, e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (k, e))",
        ]
    steps += [
        f"z AS MATERIALIZED ({near(rounds)})",
        "c AS (SELECT vec_id, string_agg(lpad(lower(to_hex(found % 256)), 2, '0'), '' ORDER BY k) AS code, sum(found // 256)::BIGINT AS error FROM z GROUP BY vec_id)",
        f"h AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: y::BIGINT), ','), ',' ORDER BY k, e)) AS h FROM b{rounds})",
    ]
    return "WITH " + ", ".join(steps) + " SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT h FROM h) AS codebooks_sha256 FROM c JOIN v USING (vec_id)"


SQL: dict[str, str] = {
    "op12_vector_codes": _codes_sql(),
    "op3_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, h, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, i // 4 * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM q""",
    "op13_resample": r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 df AS (SELECT doc_id, unnest(flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))))) AS f FROM d),
 bf AS (SELECT unnest(flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))))) AS f FROM b),
 dn AS (SELECT doc_id, f, count(*) AS n FROM df GROUP BY ALL), bn AS (SELECT f, count(*) AS n FROM bf GROUP BY ALL),
 crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
 names AS (SELECT DISTINCT f, hex(encode(f)) AS h FROM (SELECT f FROM dn UNION ALL SELECT f FROM bn)),
 bytes AS (SELECT f, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS x FROM names),
 buckets AS (SELECT f, xor(list_reduce(list_prepend(4294967295, x), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS k FROM bytes, crc),
 s AS (SELECT k, sum(n) AS s FROM dn JOIN buckets USING (f) GROUP BY k), t AS (SELECT k, sum(n) AS t FROM bn JOIN buckets USING (f) GROUP BY k),
 g AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM dn)::DOUBLE + 10000) / ((s + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM bn)::DOUBLE + 10000))))::BIGINT AS g FROM s LEFT JOIN t USING (k)),
 w AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM dn JOIN buckets USING (f) JOIN g USING (k) GROUP BY doc_id),
 scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS enough,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (doc_id)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY enough) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND r <= n * 5 // 100 THEN r END AS rank FROM ranked""",
}
