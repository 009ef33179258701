"""URL expressions (C5-C8 and link resolution for M1), all native regex work.

Our own URL clean-up rule (the reference delegates to a URL library whose
rules are not part of it): lower-case scheme and host, drop the default port,
drop the fragment, drop ``utm_*`` query parameters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions.bind import let
from sitelens.functions.text import trim_ws

HOST_RE = r"^https?://([^/?#:]+)"
ASSET_RE = r"(?i)\.(pdf|jpe?g|png|gif|svg|webp|zip|docx?|xlsx?|pptx?|mp[34]|css|js)$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_url(col) -> Column:
    """Lower-case scheme/host, drop default port, fragment and ``utm_*`` params.

    Input must carry a scheme (``x://``); other strings pass through unchanged.
    """
    def build(u):
        scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
        return let(F.struct(scheme.alias("s"),
                            F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("a"),
                            F.regexp_extract(u, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("p"),
                            F.regexp_extract(u, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*\?([^#]*)", 1).alias("q"),
                            u.alias("u")), _rebuild)
    return let(_c(col), build)


def _rebuild(x) -> Column:
    scheme, auth, path, query = x["s"], x["a"], x["p"], x["q"]
    auth = (F.when(scheme == "http", F.regexp_replace(auth, r":80$", ""))
            .when(scheme == "https", F.regexp_replace(auth, r":443$", ""))
            .otherwise(auth))
    kept = F.array_join(
        F.filter(F.split(query, "&"), lambda p: (p != F.lit("")) & ~p.startswith("utm_")), "&")
    rebuilt = F.concat(scheme, F.lit("://"), auth, path,
                       F.when(kept != F.lit(""), F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.when(scheme != F.lit(""), rebuilt).otherwise(x["u"])


def normalise_homepage(col) -> Column:
    """Trim, blank -> null, add ``https://`` (leading ``/`` stripped) when the
    value does not start with ``http://``/``https://`` (case-sensitive, as in the
    reference), then :func:`clean_url`."""
    def body(raw):
        with_scheme = (F.when(raw.startswith("http://") | raw.startswith("https://"), raw)
                       .otherwise(F.concat(F.lit("https://"), F.regexp_replace(raw, r"^/+", ""))))
        return F.when(F.coalesce(raw, F.lit("")) == F.lit(""), F.lit(None).cast("string")) \
            .otherwise(clean_url(with_scheme))
    return let(trim_ws(col), body)


def host_of(col) -> Column:
    """Host of an http(s) URL (empty string when there is none)."""
    return F.regexp_extract(_c(col), HOST_RE, 1)


def site_key(col) -> Column:
    """C6 default key: host lower-cased without a leading ``www.``; a URL without
    an http(s) host falls back to the lower-cased value itself."""
    def body(u):
        h = F.lower(host_of(u))
        return F.regexp_replace(F.when(h == F.lit(""), F.lower(u)).otherwise(h), r"^www[.]", "")
    return let(_c(col), body)


def url_path(col) -> Column:
    return F.regexp_extract(_c(col), r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_depth(col) -> Column:
    """Number of non-empty path segments."""
    return F.size(F.filter(F.split(url_path(col), "/"), lambda s: s != F.lit(""))).cast("int")


def canonical(col) -> Column:
    """Cleaned URL without trailing slashes."""
    return F.regexp_replace(_c(col), r"/+$", "")


def resolve_link(href, base) -> Column:
    """Resolve an ``href`` against the page URL ``base``.

    Absolute http(s) kept; ``//x`` takes the base scheme; ``/x`` the base origin;
    ``?q`` the base path; other relatives the base directory.  Fragments-only,
    ``mailto:``, ``tel:``, ``javascript:`` and other schemes give null.
    """
    def body(x):
        h, b = x["h"], x["b"]
        scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
        origin = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
        base_noquery = F.regexp_extract(b, r"(?s)^([^?#]*)", 1)
        # base directory: origin + path up to its last '/', or origin + '/'
        dir_path = F.regexp_extract(url_path(b), r"(?s)^(.*/)", 1)
        base_dir = F.concat(origin, F.when(dir_path == F.lit(""), F.lit("/")).otherwise(dir_path))
        kind = (F.when(h.rlike(r"(?i)^https?://"), F.lit(0))
                .when(h.startswith("//"), F.lit(1))
                .when(h.startswith("/"), F.lit(2))
                .when((h == F.lit("")) | h.startswith("#") | h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(9))
                .when(h.startswith("?"), F.lit(3))
                .otherwise(F.lit(4)))
        prefix = F.element_at(F.array(F.lit(""), F.concat(scheme, F.lit(":")), origin, base_noquery, base_dir),
                              F.least(kind, F.lit(4)) + 1)
        return F.when(kind == 9, F.lit(None).cast("string")).otherwise(without_dot_segments(F.concat(prefix, h)))
    return let(F.struct(trim_ws(href).alias("h"), _c(base).alias("b")), body)


def without_dot_segments(url) -> Column:
    """The URL with ``.`` and ``..`` path segments resolved (others untouched)."""
    def body(u):
        origin = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
        path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
        tail = F.regexp_extract(u, r"(?s)^[^?#]*([?#].*)?$", 1)
        folded = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda acc, s: (
            F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
            .when(s == ".", acc).otherwise(F.array_append(acc, s))))
        end = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
        return F.when(u.rlike(r"^[^?#]*/\.\.?([/?#]|$)"), F.concat(origin, F.array_join(folded, "/"), end, tail)).otherwise(u)
    return let(_c(url), body)


def is_asset(col) -> Column:
    return url_path(col).rlike(ASSET_RE)


def drop_fragment(col) -> Column:
    return F.regexp_extract(_c(col), r"(?s)^([^#]*)", 1)
