"""URL expressions: Column in, Column out, no Python on the executors.

The expressions are chains in which each step mentions its input once (a regular expression with look-ahead instead of a
CASE), so that they stay small when Spark copies them into filters and projections. ``norm_url`` is the entry point;
``host_of``, ``path_of``, ``base_parts`` and ``depth_of`` work on a URL that has been normalised.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .binding import let

# Limits and patterns that decide which links are admitted.
MAX_URL_LENGTH = 2000
FRAGMENT_TAIL = r"#[^#]*$"
ABSOLUTE = r"^([a-zA-Z][\w+.-]*:)?//[^/?#]+"
QUOTE_SAFE = "?=&%/"

_SEP = "\u0001"
_NOT_IN_URLS = "\t\r\n\u0001"
_NO_SCHEME = r"^(?!(?i:https?)://)(?://)?"
_WELL_BRACKETED = r"[^/?#]*//(?:[^/?#@]*@)?\[[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*\](?::[^/?#\[\]]*)?(?:[/?#]|$)"
_BAD_BRACKETS = rf"(?s)^(?!{_WELL_BRACKETED})[^/?#]*//[^/?#]*[\[\]].*$"
_EMPTY_PARAMS = r"^((?:[^?#]*/)?[^/?#;]*);(?=[?#]|$)"
_EMPTY_QUERY = r"^([^?#]*)\?(?=#|$)"
_PARTS = r"^(https?)://([^/?#]*)((?:[^?#]*/)?[^/?#;]*)(?:;([^/?#]*))?(?:\?([^#]*))?(?:#(.*))?$"
_PARTS_OUT = _SEP.join(f"${i}" for i in range(1, 7))
PART_NAMES = ("scheme", "netloc", "path", "params", "query", "fragment")
_HOST = r"^https?://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#]*)"
_PATH = r"^https?://[^/?#]*((?:[^?#]*/)?[^/?#;]*)"
_ROOT = r"^(https?://[^/?#]*)"
_TARGET = r"^https?://[^/?#]*(.*)$"
_OTHER_SCHEME = (
    r"(?i)^(?!https?:)(?!(?:localhost|[\w-]+(?:\.[\w-]+)+):\d{1,5}(?:[/?#]|$))[a-z][a-z0-9+.-]*:"
)


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip_fragment(c: Column | str) -> Column:
    """Drop the text from the last ``#`` on; NULL becomes the empty string."""
    return F.regexp_replace(_text(c), FRAGMENT_TAIL, "")


def clean(c: Column | str) -> Column:
    """Drop leading and trailing blanks and the line breaks and tabs a URL may not hold."""
    return F.trim(F.translate(_text(c), _NOT_IN_URLS, ""))


def with_scheme(c: Column | str) -> Column:
    """Give a URL without http or https the scheme http."""
    return F.regexp_replace(_text(c), _NO_SCHEME, "http://")


def norm_url(c: Column | str) -> Column:
    """Canonical text: no last fragment, lower-case scheme (http if none), host as written, empty ``;`` and ``?``
    dropped. A URL whose square brackets do not hold an IPv6 address is malformed and becomes the empty string."""
    c = with_scheme(clean(strip_fragment(c)))
    for pattern, replacement in (
        (_BAD_BRACKETS, ""),
        ("^(?i:https)://", "https://"), ("^(?i:http)://", "http://"),
        (_EMPTY_PARAMS, "$1"), (_EMPTY_QUERY, "$1"), ("#$", ""),
    ):
        c = F.regexp_replace(c, pattern, replacement)
    return c


def url_parts(c: Column | str) -> Column:
    """Struct of scheme, netloc, path, params, query and fragment; all empty for a malformed URL."""
    return let(F.split(F.regexp_replace(norm_url(c), _PARTS, _PARTS_OUT), _SEP), _named_parts)


def _named_parts(fields: Column) -> Column:
    return F.struct(*(F.coalesce(F.get(fields, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(PART_NAMES)))


def base_parts(norm: Column | str) -> Column:
    """Parts of a normalised URL, to be computed once per page before its links are resolved."""
    return let(F.split(F.regexp_replace(norm, _PARTS, _PARTS_OUT), _SEP), _named_parts)


def host_of(norm: Column | str) -> Column:
    """Host of a normalised URL: user, port and a final dot dropped."""
    return F.rtrim(F.regexp_extract(norm, _HOST, 1), F.lit("."))


def path_of(norm: Column | str) -> Column:
    return F.regexp_extract(norm, _PATH, 1)


def target_of(norm: Column | str) -> Column:
    """All of a normalised URL behind its host."""
    return F.regexp_extract(norm, _TARGET, 1)


def depth_of(norm: Column | str) -> Column:
    """Number of path segments of a normalised URL, a trailing slash not counted."""
    return F.size(F.split(F.regexp_replace(path_of(norm), "/+$", ""), "/")) - 1


def url_host(c: Column | str) -> Column:
    return host_of(norm_url(c))


def url_depth(c: Column | str) -> Column:
    return depth_of(norm_url(c))


def root_url(c: Column | str) -> Column:
    """Scheme and network location."""
    return F.regexp_extract(norm_url(c), _ROOT, 1)


def is_absolute(c: Column | str) -> Column:
    """Does the link name a host of its own?"""
    return _text(c).rlike(ABSOLUTE)


def request_path(c: Column | str) -> Column:
    """Percent-encoded path, with ``?=&%/`` left as they are."""
    path = F.url_encode(path_of(norm_url(c)))
    steps = [("+", "%20"), ("*", "%2A"), ("%7E", "~")]
    steps += [(f"%{ord(ch):02X}", ch) for ch in QUOTE_SAFE if ch != "%"] + [("%25", "%")]
    for old, new in steps:
        path = F.replace(path, F.lit(old), F.lit(new))
    return path


def _without_dot_segments(path: Column) -> Column:
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg))),
    )
    ends_in_dots = path.rlike(r"(?:^|/)\.\.?$")
    joined = F.concat(F.array_join(kept, "/"), F.when(ends_in_dots, F.lit("/")).otherwise(F.lit("")))
    return F.regexp_replace(joined, "^(?!/)", "/")


def _folded(path: Column) -> Column:
    return let(path, lambda p: F.when(p.rlike(r"/\.\.?(?:/|$)"), _without_dot_segments(p)).otherwise(p))


def _marked(mark: str, c: Column) -> Column:
    return F.when(c == "", F.lit("")).otherwise(F.concat(F.lit(mark), c))


def _resolved(link: Column, base: Column) -> Column:
    root = F.concat(base["scheme"], F.lit("://"), base["netloc"])
    to_params = F.concat(root, base["path"], _marked(";", base["params"]))
    path = F.regexp_extract(link, r"^((?:[^?#]*/)?[^/?#;]*)", 1)
    tail = F.regexp_replace(link, r"^(?:[^?#]*/)?[^/?#;]*", "")
    folder = F.regexp_replace(F.regexp_replace(base["path"], r"[^/]*$", ""), r"(?<=.)/{2,}", "/")
    below = F.concat(F.regexp_replace(folder, "^(?!/)", "/"), F.regexp_replace(path, r"/{2,}", "/"))
    return (
        F.when((link == "") | link.startswith("#"), F.concat(to_params, _marked("?", base["query"]), link))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(base["scheme"], F.lit(":"), link))
        .when(link.startswith("?"), F.concat(to_params, link))
        .otherwise(F.concat(root, _folded(F.when(path.startswith("/"), path).otherwise(below)), tail))
    )


def _relative_form(href: Column, base: Column) -> Column:
    """The link without blanks, without the scheme of its page when no host follows, and without empty markers."""
    own_scheme = let(
        clean(href),
        lambda h: F.when(
            F.lower(F.substring_index(h, ":", 1)) == base["scheme"],
            F.regexp_replace(h, "^(?i:https?):(?!//[^/?#])", ""),
        ).otherwise(h),
    )
    for pattern, replacement in ((r"^//(?=[/?#]|$)", ""), (_EMPTY_PARAMS, "$1"), (r"^\?(?=#|$)", "")):
        own_scheme = F.regexp_replace(own_scheme, pattern, replacement)
    return own_scheme


def resolve_in(hrefs: Column, base: Column) -> Column:
    """Array of links of a page to array of (href, link), ``link`` being absolute and without fragment.

    ``base`` is from ``base_parts``.
    """
    return F.transform(
        hrefs,
        lambda h: F.struct(
            h.alias("href"), strip_fragment(let(_relative_form(h, base), lambda link: _resolved(link, base))).alias("link")
        ),
    )


def resolve(href: Column | str, base: Column | str) -> Column:
    """Absolute URL of one link found on the page with the normalised URL ``base``."""
    href = F.col(href) if isinstance(href, str) else href
    return let(
        base_parts(base), lambda b: let(_relative_form(href, b), lambda link: _resolved(link, b))
    )


def any_pattern(patterns: Sequence[str]) -> str:
    """One regular expression that matches where any of the given ones does."""
    return "|".join(f"(?:{p})" for p in patterns)


def problem_of(link: Column, norm: Column, host: Column, prefix_filter: Sequence[str] = ()) -> Column:
    """``ok`` or the reason to refuse a link whose normalised URL and host are known."""
    reason = F.when((norm == "") | (host == ""), F.lit("empty")).when(
        F.length(link) > MAX_URL_LENGTH, F.lit("too_long")
    )
    if prefix_filter:
        reason = reason.when(link.rlike(any_pattern(prefix_filter)), F.lit("prefix"))
    return reason.when(link.rlike(_OTHER_SCHEME), F.lit("scheme")).otherwise(F.lit("ok"))


def link_problem(c: Column | str, prefix_filter: Sequence[str] = ()) -> Column:
    """``ok``, or the first reason to refuse a link: ``empty`` (malformed or without a host), ``too_long``, ``prefix``
    or ``scheme``.

    The length and the prefix patterns look at the link as found (fragment removed); a pattern may match anywhere.
    """
    norm = norm_url(c)
    return problem_of(strip_fragment(c), norm, host_of(norm), prefix_filter)


def valid_link(c: Column | str, prefix_filter: Sequence[str] = ()) -> Column:
    return link_problem(c, prefix_filter) == "ok"
