"""HTML expressions for page extraction (M2) and link discovery (M1).

The reference hands HTML to an extraction library.  Ours is a documented rule
set of native expressions (JVM-side, no Python per row), so exact library
output is not a goal.

The main text is a fold over the tags of a page.  A menu, header, footer, sidebar,
form or advert goes as a whole, however it is nested: its end is the closing tag
that balances its opening one, or the closing tag of something around it.  Other
closing tags inside it change nothing.  Comments and the bodies of scripts and the
like are one token each, so markup inside them is never read.  All character
references (decimal, hexadecimal, named) are decoded.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions.bind import let
from sitelens.functions.text import trim_ws

# Fixed extraction rule (ours).
RAW = ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")  # no markup inside
DROPPED = ("head", "nav", "header", "footer", "aside", "form", "noscript", "template", "svg", "select", "dialog")
HEAD_TAGS = ("head", "meta", "link", "base", "title", "script", "style", "noscript", "template")  # others end an open head
CONTAINERS = ("div", "section", "article", "main", "table", "td", "ul", "ol", "blockquote")  # their end ends what they hold
AD_TAGS = ("div", "section", "ins", "p", "ul")
AD_CLASSES = ("ad", "ads", "advert", "advertisement")
BREAKS = ("br", "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "div", "article", "section", "main", "ul", "ol", "dl", "dt",
          "dd", "table", "pre", "blockquote", "figure", "figcaption", "hr", "address", *DROPPED)
_ATTRIBUTES = r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+"""
TOKEN_RE = (r"(?is)<!--.*?(?:-->|\z)|<(" + "|".join(RAW) + r")\b[^>]*+>.*?(?:</\1\b[^>]*+(?:>|\z)|\z)"
            rf"|</?[a-z]{_ATTRIBUTES}>|</?[a-z][^>]*+(?:>|\z)|<[!?/][^>]*+(?:>|\z)|[^<]++|<")
REFERENCE_RE = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});?"
#: Tokens that the inner fold takes at a time: what it keeps is copied at every step.
FOLD_TOKENS = 256
TITLE_RE = r"(?is)<title[^>]*>(.*?)</title>"
LANG_RE = r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-zA-Z-]+)"
LINK_RE = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([^\"'>\s]*)"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- the fold over tags -------------------------------------------------------------

def _tag(token: Column) -> Column:
    """A token as what the fold needs: tag name ('' if none), opening or closing, does it start an
    advert, and what it shows outside dropped blocks."""
    name = F.lower(F.regexp_extract(token, r"^</?([a-zA-Z][a-zA-Z0-9-]*)", 1))

    def parts(x):
        n, t = x["n"], x["t"]
        opens = (n != "") & ~t.startswith("</") & ~n.isin(*RAW)
        classes = F.split(F.lower(F.regexp_extract(t, r"""(?is)\sclass\s*+=\s*+["']?+([^"'>]*+)""", 1)), r"\s+")
        ad = opens & n.isin(*AD_TAGS) & F.arrays_overlap(classes, F.array(*[F.lit(c) for c in AD_CLASSES]))
        shown = F.when(n.isin(*BREAKS), F.lit("\n")).when((n == "") & ~t.rlike(r"^<[!?/]"), t).otherwise(F.lit(""))
        return F.struct(n.alias("name"), opens.alias("opens"), t.startswith("</").alias("closes"),
                        n.isin(*CONTAINERS).alias("holds"), (ad | (opens & n.isin(*DROPPED))).alias("drops"), shown.alias("shows"))

    return let(F.struct(name.alias("n"), token.alias("t")), parts)


def _state(skip, depth, inner, outer, parts, fresh) -> Column:
    return F.struct(skip.alias("skip"), depth.cast("int").alias("depth"), inner.alias("inner"), outer.alias("outer"),
                    parts.alias("parts"), fresh.alias("fresh"))


def _step(a: Column, t: Column) -> Column:
    """The state after tag ``t``.  ``skip``: the dropped block we are in, ``depth``: how often its name
    is open, ``inner``/``outer``: names of the open containers inside and around it, the last one
    first, ``fresh``: a body began here."""
    n, zero, none, nothing = t["name"], F.lit(0), F.lit(""), F.array().cast("array<string>")
    up, down = t["opens"], t["closes"]
    body = up & (n == "body")
    ends_head = (a["skip"] == "head") & up & ~n.isin(*HEAD_TAGS)
    free = (a["skip"] == none) | ends_head
    same = ~free & (n == a["skip"])
    held = ~free & ~same & t["holds"]
    in_at, out_at = (F.array_position(a[x], n).cast("int") for x in ("inner", "outer"))
    around = held & down & (in_at == 0) & (out_at > 0)  # the end of something around the block
    depth = F.when(same & up, a["depth"] + 1).when(same & down, a["depth"] - 1).otherwise(a["depth"])
    over = (same & down & (a["depth"] == 1)) | around
    outer = F.when(around | (free & t["holds"] & down & (out_at > 0)), F.slice(a["outer"], out_at + 1, F.size(a["outer"]))) \
        .when(free & t["holds"] & up & ~t["drops"], F.array_prepend(a["outer"], n)).otherwise(a["outer"])
    inner = F.when(held & up, F.array_prepend(a["inner"], n)) \
        .when(held & down & (in_at > 0), F.slice(a["inner"], in_at + 1, F.size(a["inner"]))).otherwise(a["inner"])
    starts = free & t["drops"]
    shows = (free | over) & (t["shows"] != none)
    return (F.when(body, _state(none, zero, nothing, nothing, nothing, F.lit(True)))
            .when(starts, _state(n, F.lit(1), nothing, a["outer"], F.array_append(a["parts"], F.lit("\n")), a["fresh"]))
            .otherwise(_state(F.when(free | over, none).otherwise(a["skip"]), F.when(over, zero).otherwise(depth),
                              F.when(over, nothing).otherwise(inner), outer,
                              F.when(shows, F.array_append(a["parts"], t["shows"])).otherwise(a["parts"]), a["fresh"])))


def _visible(markup: Column) -> Column:
    """What the page shows outside dropped blocks, character references as written."""
    tokens = F.regexp_extract_all(markup, F.lit(TOKEN_RE), F.lit(0))
    nothing = F.array().cast("array<string>")
    start = _state(F.lit(""), F.lit(0), nothing, nothing, nothing, F.lit(False))

    def folded(all_tokens):
        blocks = F.sequence(F.lit(0), F.floor(F.size(all_tokens) / F.lit(FOLD_TOKENS)).cast("int"))

        def block(a, i):
            some = F.transform(F.slice(all_tokens, i * FOLD_TOKENS + 1, F.lit(FOLD_TOKENS)), _tag)
            at = _state(a["skip"], a["depth"], a["inner"], a["outer"], nothing, F.lit(False))
            return let(F.aggregate(some, at, _step), lambda b: _state(
                b["skip"], b["depth"], b["inner"], b["outer"], F.array_append(
                    F.when(b["fresh"], nothing).otherwise(a["parts"]), F.array_join(b["parts"], "")),
                F.lit(False)))

        return F.array_join(F.aggregate(blocks, start, block)["parts"], "")

    return let(tokens, folded)


# --- character references -------------------------------------------------------------

def _names() -> str:
    """Named references of the HTML standard as JSON: ``name;`` and, where the standard allows it, ``name``."""
    return json.dumps({k: " " if v == "\xa0" else v for k, v in html.entities.html5.items()})


def _code_points() -> str:
    """Code points 128 to 159 mean what they do in windows-1252."""
    odd = {i: bytes([i]).decode("cp1252", "ignore") for i in range(128, 160)}
    return json.dumps({str(i): c for i, c in odd.items() if c} | {"160": " "})


def decode_references(text: Column) -> Column:
    """All character references of ``text``; unknown names stay as written, impossible code points
    become U+FFFD, the non-breaking space a blank."""
    names = F.from_json(F.lit(_names()), "map<string,string>")
    points = F.from_json(F.lit(_code_points()), "map<string,string>")

    def one(r):
        digits = F.regexp_extract(r, r"^&#[xX]?([0-9A-Fa-f]+)", 1)
        code = F.when(F.substring(r, 3, 1).isin("x", "X"), F.conv(digits, 16, 10)).otherwise(digits).cast("bigint")

        def point(c):
            good = (c > 0) & (c <= 0x10FFFF) & ~c.between(0xD800, 0xDFFF)
            char = F.decode(F.unhex(F.lpad(F.hex(F.when(good, c).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
            return F.coalesce(F.element_at(points, c.cast("string")), char)

        return F.when(r.startswith("&#"), let(code, point)).otherwise(
            F.coalesce(F.element_at(names, F.substr(r, F.lit(2))), r))

    def joined(x):
        refs = F.regexp_extract_all(x, F.lit(REFERENCE_RE), F.lit(0))
        parts = F.split(x, REFERENCE_RE, -1)
        return F.array_join(F.zip_with(parts, refs, lambda p, r: F.concat(p, F.coalesce(one(r), F.lit("")))), "")

    return let(text, lambda x: F.when(F.contains(x, F.lit("&")), joined(x)).otherwise(x))


def main_text(markup) -> Column:
    """The text of a page: lines where blocks and breaks are, no line blank, no blanks around lines' ends."""
    t = decode_references(_visible(_c(markup)))
    t = F.regexp_replace(t, r" *\n[ \n]*", "\n")
    return F.regexp_replace(t, r"^[ \n]+|[ \n]+$", "")


def title(html) -> Column:
    return F.nullif(trim_ws(F.regexp_extract(_c(html), TITLE_RE, 1)), F.lit(""))


def language(html) -> Column:
    return F.nullif(F.regexp_extract(_c(html), LANG_RE, 1), F.lit(""))


def links(html) -> Column:
    """All ``<a href>`` values in document order (array<string>)."""
    return F.regexp_extract_all(_c(html), F.lit(LINK_RE), F.lit(1))
