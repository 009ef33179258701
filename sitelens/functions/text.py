"""Text expressions (J1-J7, J9, J21, J22, D7, D8) as native Column expressions.

Everything here is a JVM-side expression (regexp / string / higher-order
functions), so it stays inside whole-stage codegen.  The same regular
expressions are valid in Java and RE2, which lets DuckDB act as the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions.bind import let

# Whitespace as Python's ``str.split()`` / ``str.strip()`` see it (Unicode
# White_Space plus the four information separators 0x1C-0x1F).  Java's ``\s`` is
# ASCII-only and ``(?U)\s`` misses 0x1C-0x1F, so the class is spelled out.
WS_CLASS = (r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS = f"[{WS_CLASS}]"
WS_CHARS = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                    0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
WORD_CLASS = r"\p{L}\p{N}_"

# Fixed values that must equal the reference: the nine interstitial markers
# (checked in the lower-cased first 2,000 characters of a page).
JUNK_MARKERS = (
    "your request is being verified",
    "just a moment",
    "enable javascript and cookies to continue",
    "checking your browser",
    "verifying you are human",
    "review the security of your connection",
    "performance & security by cloudflare",
    "ddos protection by",
    "attention required",
)
JUNK_HEAD_CHARS = 2000

# Cleaning steps of J1, applied in order after lower-casing.
CLEAN_STEPS = (
    (r"<[^>]+>", " "),
    (rf"https?://[^{WS_CLASS}]+|www\.[^{WS_CLASS}]+", " "),
    (rf"[{WORD_CLASS}.+-]+@[{WORD_CLASS}-]+\.[{WORD_CLASS}.-]*[{WORD_CLASS}]", " "),
    (rf"[^a-zà-öø-ÿ{WS_CLASS}]", " "),
    (rf"{WS}+", " "),
    (r"^ | $", ""),
)

# The same in Java with less to read and write.  An address starts where its run of characters starts (or
# where the match before ended), so no other place of a run is tried; the last three steps are one: every
# run of what is no letter becomes a space, and a single space is left alone.
_ADDRESS = (rf"(?:(?<![{WORD_CLASS}.+-])|\G)[{WORD_CLASS}.+-]++@[{WORD_CLASS}-]+\.[{WORD_CLASS}.-]*[{WORD_CLASS}]", " ")
# The letters are listed, not given as ranges: Java looks listed ones up in a bit set.
_OTHER = "[^" + "".join(chr(c) for c in (*range(0x61, 0x7B), *range(0xE0, 0xF7), *range(0xF8, 0x100))) + "]"
_OTHERS = f"{_OTHER}(?:{_OTHER}++|(?<! ))"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def trim_ws(col) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends, looking at the ends only."""
    return F.btrim(_c(col), F.lit(WS_CHARS))


def is_blank(col) -> Column:
    """True when null or only whitespace (Python ``not (s or '').strip()``)."""
    return ~F.coalesce(_c(col).rlike(f"[^{WS_CLASS}]"), F.lit(False))


def text_true(col) -> Column:
    """CSV boolean text: ``(s or '').strip().lower() == 'true'``."""
    return F.coalesce(F.lower(trim_ws(col)) == F.lit("true"), F.lit(False))


# A cleaning step can only match when its marker occurs in the text; texts
# without it skip the (Unicode-class) regex pass.
_GUARDED_STEPS = ((*CLEAN_STEPS[0], ("<",)), (*CLEAN_STEPS[1], ("http", "www.")), (*_ADDRESS, ("@",)))


def clean_text(col) -> Column:
    """Lower, strip tags, URLs, e-mails, keep Latin-1 letters, collapse (:data:`CLEAN_STEPS`)."""
    out = F.lower(_c(col))
    for pat, rep, guard in _GUARDED_STEPS:
        out = let(out, _guarded(pat, rep, guard))
    return F.btrim(F.regexp_replace(out, _OTHERS, " "), F.lit(" "))


def _guarded(pat: str, rep: str, guard):
    def step(t):
        return F.when(contains_any(t, guard), F.regexp_replace(t, pat, rep)).otherwise(t)
    return step


def char_count(col) -> Column:
    """Code points."""
    return F.length(_c(col)).cast("bigint")


def byte_count(col) -> Column:
    """UTF-8 bytes."""
    return F.octet_length(_c(col)).cast("bigint")


def word_count(col) -> Column:
    """``len(text.split())`` = the number of maximal non-whitespace runs,
    counted in place (no array of words is built)."""
    return F.regexp_count(_c(col), F.lit(f"[^{WS_CLASS}]+")).cast("bigint")


def line_count(col) -> Column:
    """Newline count plus one for a non-empty text not ending in newline."""
    def body(c):
        nl = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
        tail = F.when((F.length(c) > 0) & ~c.endswith("\n"), F.lit(1)).otherwise(F.lit(0))
        return (nl + tail).cast("bigint")
    return let(_c(col), body)


def token_estimate(col) -> Column:
    """J6 default counter: ceil(chars / 4) (the reference's chars/4 rule)."""
    return F.ceil(F.length(_c(col)) / F.lit(4)).cast("bigint")


def truncate(col, n: int) -> Column:
    """First ``n`` code points."""
    return F.substring(_c(col), 1, n)


def is_junk(col, markers=JUNK_MARKERS, head_chars: int = JUNK_HEAD_CHARS) -> Column:
    """Any marker in the lower-cased head of the text."""
    return let(F.lower(F.substring(_c(col), 1, head_chars)), lambda head: contains_any(head, markers))


def contains_any(col, needles) -> Column:
    """True when any of the fixed strings occurs in ``col``."""
    cond = F.lit(False)
    for m in needles:
        cond = cond | F.contains(col, F.lit(m))
    return cond


def is_short(col, n: int) -> Column:
    """True when the stripped text has under ``n`` code points; reading stops where that is known."""
    if n < 2:
        return F.length(trim_ws(col)) < n
    return ~_c(col).rlike(rf"(?s)[^{WS_CLASS}].{{{n - 2}}}.*?[^{WS_CLASS}]")


def language_label(text, detected, min_chars: int = 25, junk: Column | None = None) -> Column:
    """``blocked`` (junk, checked first), ``short``, detector label or ``unknown``."""
    out = (F.when(is_short(text, min_chars), F.lit("short"))
           .otherwise(F.coalesce(_c(detected), F.lit("unknown"))))
    if junk is not None:
        out = F.when(junk, F.lit("blocked")).otherwise(out)
    return out


def pct(num, den, digits: int = 2) -> Column:
    """``round(100 * num / den, digits)``, null when den is 0."""
    return F.round(F.try_divide(F.lit(100.0) * _c(num), _c(den).cast("double")), digits)


def format_duration(col) -> Column:
    """``H:MM:SS`` when hours > 0 else ``M:SS``; negatives become 0."""
    s = F.greatest(F.floor(_c(col).cast("double")), F.lit(0)).cast("bigint")
    h = F.floor(s / 3600).cast("bigint")
    m = F.floor((s % 3600) / 60).cast("bigint")
    sec = (s % 60).cast("bigint")
    return (F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, sec))
            .otherwise(F.format_string("%d:%02d", m, sec)))


def safe_key(col, max_len: int | None = None, fallback: str | None = None) -> Column:
    """Characters outside ``[A-Za-z0-9._-]`` become ``_``; crawl variant cuts
    to ``max_len`` and falls back to ``fallback`` when empty.  A label, not a key."""
    out = F.regexp_replace(_c(col), r"[^A-Za-z0-9._-]", "_")
    if max_len is not None:
        out = F.substring(out, 1, max_len)
    if fallback is not None:
        out = F.coalesce(F.nullif(out, F.lit("")), F.lit(fallback))
    return out
