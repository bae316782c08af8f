"""Text-quality expressions: every function takes and returns Columns, so all of it stays in generated code."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# They define the results and are kept as plain text.
TRIM_CHARS = "•·_|~`^ "
PUNCTUATION = "，。！？；：、,.!?;:'\"-()[]（）【】《》“”‘’…"
NORMALIZE_DELETES = " \t\r\n" + PUNCTUATION
LEAST_REAL_SHARE = 0.55
SENTENCE_MARKS = "[.?!,:;]"
ASCII_LETTER = "[A-Za-zİK]"
CJK = "[一-鿿]"
GLUE_MARKERS = ["itwhere", "itswhere", "whereour", "ourjourney", "journeybegins", "tomake", "theaspiration", "withinreach", "findyour", "thisisour", "isourmission", "effortlessconfidence"]
NOISE_WORDS = ["TODAUT"]
LEAST_SCORE = 0.82
# Replaceable repair rules, in order; pattern and replacement, case ignored, whole words.
REPAIRS = [
    ("ForMG", "For MG"),
    ("it'?swhereourjourneybegins", "it's where our journey begins"),
    (r"it'?swhere\s*ourjourneybegins", "it's where our journey begins"),
    ("ourjourneybegins", "our journey begins"),
    ("effortlessconfidence", "effortless confidence"),
    ("evoletion", "evolution"),
    ("THISISOURMISSION", "THIS IS OUR MISSION"),
    ("tomake", "to make"),
    ("theaspiration", "the aspiration"),
    ("impossiblewithinreach", "impossible within reach"),
    ("Findyourhore", "Find your more"),
    ("Findyourmore", "Find your more"),
    ("out ofit", "out of it"),
    ("Orthe", "Or the"),
    ("Wnether", "Whether"),
    ("KEEPTHE", "KEEP THE"),
    ("PUNC", "PUNCH"),
    ("traric", "traffic"),
    ("Piug-in", "Plug-in"),
    ("Plug In", "Plug-in"),
    ("Hybridr", "Hybrid+"),
    ("foreveryone", "for everyone"),
    ("eyon atlow", "even at low"),
    (r"tem!\s*t-rures", "temperatures"),
    ("jirovides", "provides"),
    ("Eof power", "of power"),
    ("und fuel", "and fuel"),
    ("speedst", "speeds"),
    ("further reduce", "further reduces"),
    ("TECHFORMORE", "TECH FOR MORE"),
]

SPACE = r"[\s\x1c-\x1f]"
# The same characters as (?U)SPACE finds, by number: a search in letters and digits is several times as fast.
BLANKS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at either end; null stays null."""
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))  # most texts have nothing to strip, and a search takes long
    return F.when(ends.rlike(f"(?U){SPACE}"), F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+$", "")).otherwise(c)


def squeeze(c: Column) -> Column:
    """Stripped, with every white-space run as one space."""
    return strip(_single_spaces(c))


def _single_spaces(c: Column) -> Column:
    """Every white-space run as one space; a single space is no match, so most texts are only searched."""
    return F.regexp_replace(c, f"[{BLANKS}&&[^ ]][{BLANKS}]*| [{BLANKS}]+", " ")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row however often it is used."""
    return F.transform(F.array(value), use)[0]


def _spoken(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def in_class(chars: str) -> str:
    """Characters as the inside of a regular expression's class."""
    return "".join("\\" + x if x in "[]\\^-&" else x for x in chars)


def _by_halves(chars: str) -> tuple[str, str]:
    """The ASCII characters as the inside of a class, and a class of the others that looks at its range first."""
    wide = sorted(x for x in chars if x > "\x7f")
    return in_class("".join(x for x in chars if x <= "\x7f")), f"[{wide[0]}-{wide[-1]}&&[{in_class(''.join(wide))}]]"


def real_share(c: Column) -> Column:
    """Share of letters, digits and known punctuation."""
    plain, wide = _by_halves(PUNCTUATION)
    other = F.regexp_replace(c, rf"[A-Za-z0-9{plain}]+|\p{{L}}|\p{{N}}|{wide}", "")
    return (F.length(c) - F.length(other)) / F.greatest(F.length(c), F.lit(1))


def clean_text(c: Column, min_length: Column | int = 2) -> Column:
    """Squeezed and trimmed text; null if it is short or mostly symbols."""
    told = lambda t: F.when((F.length(t) >= min_length) & (real_share(t) >= LEAST_REAL_SHARE), t)
    return F.when(c != "", let(F.btrim(_single_spaces(c), F.lit(TRIM_CHARS)), told))  # TRIM_CHARS has the space


def normalize(c: Column) -> Column:
    """Lower case without punctuation and ASCII white space: the form that similarity compares."""
    plain, wide = _by_halves(NORMALIZE_DELETES)
    return F.regexp_replace(F.lower(c), f"[{plain}]+|{wide}", "")


def count_characters(c: Column, one: str) -> Column:
    """How many characters a pattern finds that takes letters of runs one by one or together; none is gathered."""
    return F.length(c) - F.length(F.regexp_replace(c, one, ""))


def compact(c: Column) -> Column:
    """The ASCII letters and digits."""
    return F.regexp_replace(c, "[^A-Za-z0-9]", "")


def words(c: Column) -> Column:
    """The runs of ASCII letters."""
    return F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0))


def tokens(c: Column) -> Column:
    """The runs of ASCII letters and digits."""
    return F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0))


def strip_tags(c: Column) -> Column:
    """Without markup tags."""
    return F.regexp_replace(c, "<[^>]+>", "")


def preview(c: Column, limit: int = 220) -> Column:
    """Squeezed text, cut with dots if it is over the limit."""
    t = squeeze(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 1), F.lit("...")))


def is_safe_correction(c: Column) -> Column:
    """One line of 1 to 500 characters."""
    t = strip(c)
    return F.coalesce((t != "") & (F.length(t) <= 500) & ~t.rlike(r"[\r\n]"), F.lit(False))


def _size_in(c: Column, low: int, high: int) -> Column:
    return F.length(c).between(low, high)


def _caps_code(v: Column, k: Column) -> Column:
    """Short and all capitals with a digit, or shorter without sentence marks; k: v's letters and digits."""
    return _size_in(k, 2, 10) & ~k.rlike("[a-z]") & (k.rlike("[0-9]") | (_size_in(k, 2, 5) & ~v.rlike(SENTENCE_MARKS)))


def is_hard_noise(c: Column) -> Column:
    """Text that can't be speech: codes, plate numbers, single mixed-case tokens, rows of short tokens."""
    def single(v: Column) -> Column:
        mixed = lambda k: (k.rlike("[a-z]") & (F.regexp_count(k, F.lit("[A-Z]")) >= 3)) | F.upper(k).isin(NOISE_WORDS)
        return v.rlike(r"^[^A-Za-z0-9]*[A-Za-z0-9]{4,12}[^A-Za-z0-9]*\z") & let(compact(v), mixed)

    def capitals(v: Column, k: Column) -> Column:
        n = F.regexp_count(v, F.lit("[A-Za-z0-9]+"))
        short = n - F.regexp_count(v, F.lit("[A-Za-z0-9]{4,}"))
        row = k.rlike("[0-9]") & n.between(4, 12) & (short >= 0.75 * n)
        return k.rlike("^[0-9]+$") | _caps_code(v, k) | row

    def told(v: Column) -> Column:
        return (v != "") & ((F.length(v) <= 2) | single(v) | (~v.rlike("[a-z]") & let(compact(v), lambda k: capitals(v, k))))

    return let(_spoken(c), told)


def _unspaced(c: Column, w: Column) -> Column:
    letters = F.regexp_replace(c, "[^A-Za-z]", "")
    spaced = lambda: c.contains(" ") & (F.size(F.filter(F.split(squeeze(c), " "), lambda x: x != "")) >= F.size(w))
    capital = let(letters, lambda x: (F.length(x) >= 12) & (F.regexp_count(x, F.lit("[A-Z]")) >= 0.85 * F.length(x)))
    return F.size(w).between(1, 4) & F.exists(w, lambda x: F.length(x) >= 7) & capital & ~spaced()


def is_unspaced_uppercase(c: Column) -> Column:
    """One to four words of capitals with spaces missing."""
    return let(c, lambda x: let(words(x), lambda w: _unspaced(x, w)))


def _glued(c: Column) -> Column:
    marked = lambda k: reduce(lambda x, y: x | y, [k.contains(m) for m in GLUE_MARKERS])
    long = lambda: c.rlike("[A-Za-z]{13,}")
    return let(F.regexp_replace(c, "[^A-Za-z']", ""), lambda k: (F.length(k) >= 12) & (let(F.lower(k), marked) | (k.rlike("[a-z][A-Z]") & long())))


def is_glued_english(c: Column) -> Column:
    """Words run together: a known pair, or a capital inside a word beside a long word."""
    return let(c, _glued)


def _mixes_scripts(v: Column) -> Column:
    return v.rlike(CJK) & (F.regexp_count(v, F.lit(ASCII_LETTER)) >= 2)


def _doubtful(v: Column) -> Column:
    def told(w: Column, letters: Column) -> Column:
        many = (F.size(w) >= 2) & ((letters >= 14 * F.size(w)) | _unspaced(v, w) | _glued(v))
        return ((F.size(w) == 1) & (letters >= 18)) | many

    length = lambda w: F.aggregate(w, F.lit(0), lambda n, x: n + F.length(x))
    by_words = let(words(v), lambda w: let(length(w), lambda letters: told(w, letters)))
    return (F.length(v) <= 2) | (~v.rlike("[a-z]") & let(compact(v), lambda k: _caps_code(v, k))) | by_words | _mixes_scripts(v)


def needs_review(c: Column, has_reviewer: Column | bool = True) -> Column:
    """Whether a second recognizer should read this text."""
    reviewer = F.lit(has_reviewer) if isinstance(has_reviewer, bool) else has_reviewer
    return reviewer & let(_spoken(c), _doubtful)


def prefers_review(primary: Column, review: Column, has_reviewer: Column | bool = True) -> Column:
    """Whether the second reading replaces the first."""
    def told(p: Column, r: Column) -> Column:
        better = needs_review(p, has_reviewer) & ((F.length(r) > 1.25 * F.length(p)) | ~needs_review(r, has_reviewer))
        return (r != "") & ~is_hard_noise(r) & ((p == "") | better)

    return let(_spoken(primary), lambda p: let(_spoken(review), lambda r: told(p, r)))


def accepts_token(c: Column, score: Column, least: float = LEAST_SCORE) -> Column:
    """Whether a scored token of a recognizer counts; a null score passes."""
    def told(v: Column) -> Column:
        marked = v.rlike(SENTENCE_MARKS)
        lone = let(words(v), lambda w: (F.size(w) == 1) & (F.length(F.get(w, F.lit(0))) <= 6)) & ~marked
        return (F.length(v) > 1) & ((F.length(v) > 3) | marked) & ~let(compact(v), lambda k: _caps_code(v, k)) & ~F.coalesce(lone, F.lit(False)) & ~_mixes_scripts(v)

    return F.coalesce(score >= least, F.lit(True)) & let(_spoken(c), told)


def repair(c: Column, rules: list[tuple[str, str]] = REPAIRS) -> Column:
    """Recognized text with known misreadings repaired; noise becomes empty. Rules run only on texts that one of them fits."""
    def ruled(v: Column) -> Column:
        if not rules:
            return v
        fits = v.rlike(rf"(?iU)\b(?:{'|'.join(r[0] for r in rules)})\b")
        return F.when(fits, reduce(lambda x, r: F.regexp_replace(x, rf"(?iU)\b{r[0]}\b", r[1].replace("$", r"\$")), rules, v)).otherwise(v)

    def trimmed(x: Column) -> Column:
        x = F.regexp_replace(x, r"(?U),(?=\S)", ", ")
        x = F.regexp_replace(x, r"\.{2,}$", ".")
        x = F.regexp_replace(x, r"(?U)^G Plug-in\b", "MG Plug-in")
        return F.regexp_replace(x, r"(?iU)^ah\s+\.\S+\s+", "")

    def told(x: Column) -> Column:
        lost = x.rlike(r"(?iU)\btechnol\b") & x.rlike(r"(?iU)\bti+me\b")
        tail = F.when(F.regexp_count(x, F.lit("[A-Za-z]+")) >= 3, strip(F.regexp_replace(x, r"(?U)\s+\d\s*$", ""))).otherwise(x)
        return F.when(lost, F.lit("")).otherwise(tail)

    return let(_spoken(c), lambda v: F.when((v == "") | is_hard_noise(v), F.lit("")).otherwise(let(trimmed(ruled(v)), told)))
