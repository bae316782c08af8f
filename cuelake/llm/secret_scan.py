"""Secret scans: three fixed patterns, and strings that a primed compressor can't shorten.

The compressor is zstandard with a dictionary of code words and identifiers, followed by the text around a candidate.
What a candidate adds to the compressed size of its surroundings, over its length, is its novelty: words and
identifiers add little, keys and passwords about as many bytes as they have.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import small_batches, text_or_empty

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
MARK = re.compile(r"(?i)passw|secret|token|api_?key", re.ASCII)
#: Strings that may be a secret of no fixed form, and the words that make their surroundings sensitive.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"(?i)passw|secret|token|api[_-]?key|credential|private|access[_-]?key|auth|bearer|client[_-]?id|signature|aws", re.ASCII)
BEFORE, AFTER, NOVELTY = 64, 32, 0.72

WORDS = """
and as assert async await bool boolean break case catch char class const continue def default delete do double elif else enum
except export extends false final finally float for from function global go if implements import in include int interface
is lambda let long new nil none not null or package pass private protected public raise return select self short static
string struct super switch this throw throws true try type typedef union unsigned use using var void while with yield
abstract account action address alert amount application array attribute author backend balance batch binary body buffer
builder button cache calendar callback category channel check client cluster collection column command comment compare
component config configuration connection console container content context controller convert cookie count country create
currency current customer database dataset date decode description detail device dictionary directory document domain
download element email encode endpoint entity environment error event example exception execute factory field file filter
folder format frame frontend gateway generator group handler header height helper history identifier image index input
instance integer invoice iterator job language layout length level library license limit link list listener loader local
location logger login manager mapping master matrix media member memory menu message metadata method metric middleware
migration mobile model module monitor network node notification number object offset operation option order output owner
page panel parameter parent parser partition password path payload payment permission pipeline platform plugin pointer
policy position prefix primary priority process processor product profile project property protocol provider proxy query
queue random range record reference region register release remote render report repository request resource response
result role route router runtime sample schedule schema scope script search section security segment sequence serial
server service session setting signal size snapshot socket source stack state status storage stream style subject
summary support symbol system table target task template test text thread timeout timestamp title token topic total
transaction transfer tree trigger update upload user utility validate validator value variable vector version video view
volume web widget width window worker wrapper secret api_key access_key client_id client_secret auth_token bearer
""".split()
IDENTIFIERS = " ".join(WORDS + [w.upper() for w in WORDS] + [w.capitalize() for w in WORDS]).encode()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(kind's place, start, end) of the fixed patterns."""
    found = []
    if MARK.search(text):
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return found


class Novelty:
    """Measures what a string adds to the compressed size of what stands around it."""

    def __init__(self, level: int = 3) -> None:
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self._zstd = zstandard.ZstdCompressor(level=level, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)

    def __call__(self, before: str, string: str, after: str) -> float:
        around = (before + "\n" + after + "\n").encode("utf-8", "replace")
        s = string.encode()
        return (len(self._zstd.compress(around + s)) - len(self._zstd.compress(around))) / len(s)


def spans(text: str, novelty: Novelty, least: float = NOVELTY) -> list[tuple[int, int, int]]:
    """Every span, by start and then kind."""
    found = base_spans(text)
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)):
            continue
        before = text[max(0, m.start() - BEFORE) : m.start()]
        if not SENSITIVE.search(before):
            continue
        if novelty(before, s, text[m.end() : m.end() + AFTER]) >= least:
            found.append((3, m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], x[0], x[2]))


def scan(docs: DataFrame, least: float = NOVELTY) -> DataFrame:
    """(doc_id, spans array of (kind, start, end)) of every row, positions in code points, ends exclusive.

    A null or empty text has no spans; repeated rows and null ids keep their rows; other columns are left out.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            got = [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans(t, novelty, least)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, least: float = NOVELTY, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every span that holds a secret replaced by the mask; no row is dropped.

    Overlapping spans are masked as one. n_chars, where there is such a column, follows the new text. A null text stays null.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def clean(text: str | None, novelty: Novelty) -> str | None:
        out, upto = [], 0
        for _, s, e in spans(text or "", novelty, least):
            if s >= upto:
                out += [text[upto:s], mask]
            upto = max(upto, e)
        return "".join([*out, text[upto:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for b in batches:
            yield b.set_column(at, "text", pa.array([clean(t, novelty) for t in b.column("text").to_pylist()], pa.string()))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def report(docs: DataFrame, least: float = NOVELTY) -> DataFrame:
    """Counts of the fixed kinds, the digest of their spans, and all spans joined, for each document."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x.kind == k)).cast("long")
    base = F.filter("spans", lambda x: x.kind != "novel")
    return scan(docs, least).select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def digest(found: list[tuple[int, int, int]]) -> str:
    """The digest of base spans, for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(found, key=lambda x: (x[1], x[0]))).encode()).hexdigest()
