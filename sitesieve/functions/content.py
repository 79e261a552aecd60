"""Expressions on a fetched response: status, type, encoding, links and text."""

from __future__ import annotations

import codecs
from encodings.aliases import aliases
from html.entities import html5

from pyspark.sql import Column, functions as F

from .binding import let

# The quoted href pattern, the default retry pause and the status ranges.
HREF = r"href\s*=\s*['\"]\s*([^'\"]+)['\"]"
DEFAULT_RETRY_AFTER = 500
PROCESS_STATUS = (200, 226)
REDIRECT_STATUS = (301, 308)
RETRY_STATUS = 408
WAIT_STATUS = (413, 428)

MARKUP_ENTITIES = (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "))

# Characters of windows-1252 at the bytes 0x80 to 0x9F (five bytes are undefined and stay).
WINDOWS_1252_EXTRA = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"

# Charsets of two or four bytes a character, with their names in Spark, and those of one byte; the characters of the upper
# half of these come from the codecs of the standard library.
WIDE = {"utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE", "utf-16": "UTF-16", "utf-32": "UTF-32"}
SINGLE_BYTE = (
    *(f"windows-{n}" for n in range(1250, 1259)),
    *(f"iso-8859-{n}" for n in (*range(2, 12), *range(13, 17))),
    "koi8-r", "koi8-u", "cp866", "mac-roman",
)
# Charsets of one or several bytes, with their names on the Java platform (see ``session.tune``); the first holds the two older ones of its country.
MULTI_BYTE = {"gb18030": "GB18030", "big5": "Big5-HKSCS", "shift-jis": "windows-31j", "euc-jp": "EUC-JP", "euc-kr": "x-windows-949"}
ALSO = {"gb18030": ("gbk", "gb2312"), "big5": ("big5hkscs", "cp950"), "shift-jis": ("cp932",), "euc-kr": ("cp949",)}
UPPER_HALF = "".join(chr(b) for b in range(0x80, 0x100))


def _upper_half(name: str) -> str:
    """Characters of the bytes from 0x80 on; an undefined byte stays as it is."""
    text = (bytes([b]).decode(name, "ignore") or chr(b) for b in range(0x80, 0x100))
    return "".join(text)


# What is not text: prolog, comments, head, scripts, styles and every other tag. One pass; an unclosed comment, script
# or style reaches to the end, and a tag never runs past the next "<", so that the time stays linear in the page.
NOT_TEXT = (
    r"(?is)<(?:\?xml.*?\?>|!--.*?(?:-->|\z)|head\b.*?(?:</head\s*>|<body\b[^<>]*>)"
    r"|script\b.*?(?:</script\s*>|\z)|style\b.*?(?:</style\s*>|\z)|[/!?a-z][^<>]*>)"
)
ENTITY_NAME = "^(#?[A-Za-z0-9]+);"
BLANKS = r"[ \t\r\n\f]+"
XML_PROLOG = r"(?is)^\s*<\?xml.*?\?>"
# A word is a letter with the letters and marks that follow, in any script; where words are written without blanks
# between them, each character is one.
WORD = (
    r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]|\p{L}[\p{L}\p{M}]*"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def status_action(c: Column | str) -> Column:
    """What a response status asks for: process, redirect, retry, wait or fail."""
    c = _col(c)
    return (
        F.when(c.between(*PROCESS_STATUS), F.lit("process"))
        .when(c.between(*REDIRECT_STATUS), F.lit("redirect"))
        .when(c == RETRY_STATUS, F.lit("retry"))
        .when(c.isin(*WAIT_STATUS), F.lit("wait"))
        .otherwise(F.lit("fail"))
    )


def type_accepted(content_type: Column | str, pattern: str) -> Column:
    """The header matches the pattern anywhere, or is missing."""
    content_type = _col(content_type)
    return content_type.isNull() | content_type.rlike(pattern)


def header(headers: Column | str, name: str) -> Column:
    """Value of a response header, whatever the case of its name."""
    lowered = F.transform_keys(F.map_filter(_col(headers), lambda k, v: F.lower(k) == name.lower()), lambda k, v: F.lower(k))
    return F.element_at(lowered, name.lower())


def _declared_charset(content_type: Column, body: Column) -> Column:
    from_header = F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset\s*=\s*[\"']?([\w.:-]+)", 1)
    as_latin = F.decode(body, "ISO-8859-1")
    from_meta = F.regexp_extract(as_latin, r"(?i)<meta[^<>]+charset\s*=\s*[\"']?([\w.:-]+)", 1)
    return F.lower(F.when(from_header != "", from_header).otherwise(from_meta))


def _labels(name: str) -> list[str]:
    """Labels of a charset: its name and what the standard library calls it, with either kind of stroke."""
    codec = codecs.lookup(name).name.replace("-", "_")
    known = {name, codec, *(alias for alias, of in aliases.items() if of == codec)}
    for other in ALSO.get(name, ()):
        known |= {other, *(alias for alias, of in aliases.items() if of == other)}
    if name == "shift-jis":
        known.add("x-sjis")
    if name.startswith("windows-"):
        known |= {"cp" + name[8:], "x-cp" + name[8:]}
    return sorted({label.replace("_", "-") for label in known} | {label.replace("_", "") for label in known})


def body_encoding(body: Column | str, content_type: Column | str) -> Column:
    """Charset of a byte order mark, else the declared one if it is known, else utf-8 if the bytes are valid utf-8, else
    iso-8859-1, which fits any bytes. A body declared utf-8 that is not is iso-8859-1 as well."""
    body, content_type = _col(body), _col(content_type)
    marks = ((b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"), (b"\xef\xbb\xbf", "utf-8"))

    def of(declared: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for mark, name in marks:
            out = out.when(F.startswith(body, F.lit(mark)), F.lit(name))
        for name in (*WIDE, *MULTI_BYTE, *SINGLE_BYTE, "iso-8859-1"):
            out = out.when(declared.isin(*_labels(name)), F.lit(name))
        return out.when(F.is_valid_utf8(body.cast("string")), F.lit("utf-8")).otherwise(F.lit("iso-8859-1"))

    return let(F.translate(_declared_charset(content_type, body), "_", "-"), of)


def decoded(body: Column | str, encoding: Column | str) -> Column:
    """Text of the bytes in the encoding found by ``body_encoding``, without a byte order mark."""
    body, encoding = _col(body), _col(encoding)
    latin = F.decode(body, "ISO-8859-1")
    out = F.when(encoding == "utf-8", body.cast("string"))
    for name in WIDE:
        # UTF-32 is read in the order of the network
        out = out.when(encoding == name, F.decode(body, WIDE[name]))
    for name in MULTI_BYTE:
        out = out.when(encoding == name, F.decode(body, MULTI_BYTE[name]))
    for name in SINGLE_BYTE:
        out = out.when(encoding == name, F.translate(latin, UPPER_HALF, _upper_half(name)))
    return F.regexp_replace(out.otherwise(latin), "^\ufeff", "")


def hrefs(html: Column | str) -> Column:
    """Every quoted href of the page, in order."""
    return F.regexp_extract_all(_col(html), F.lit(HREF), F.lit(1))


def without_prolog(html: Column | str) -> Column:
    return F.regexp_replace(_col(html), XML_PROLOG, "")


def _named(name: Column) -> Column:
    """Characters of an entity of the HTML standard, as one constant map."""
    table = "\x01".join(f"{known[:-1]}\x02{text}" for known, text in html5.items() if known.endswith(";"))
    return F.element_at(F.str_to_map(F.lit(table), F.lit("\x01"), F.lit("\x02")), name)


def _character(name: Column) -> Column:
    """Characters of an entity name or number, a blank for one that is not known, NULL for no name."""
    decimal = F.nullif(F.regexp_extract(name, r"^#0*(\d{1,7})$", 1), F.lit(""))
    hexadecimal = F.nullif(F.regexp_extract(name, "^#[xX]0*([0-9A-Fa-f]{1,6})$", 1), F.lit(""))
    code = F.coalesce(decimal, F.conv(hexadecimal, 16, 10)).cast("int")
    out = F.when(name == "", F.lit(None))
    for known, character in MARKUP_ENTITIES:
        out = out.when(name == known, F.lit(character))
    return (
        out.when(code.between(0x80, 0x9F), F.substr(F.lit(WINDOWS_1252_EXTRA), code - 0x7F, F.lit(1)))
        .when(
            code.between(32, 0xD7FF) | code.between(0xE000, 0xFFFD) | code.between(0x10000, 0x10FFFF),
            F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32"),
        )
        .when(code.isNotNull(), F.lit(" "))
        .otherwise(F.coalesce(_named(name), F.lit(" ")))
    )


def _after_ampersand(piece: Column) -> Column:
    character = let(F.regexp_extract(piece, ENTITY_NAME, 1), _character)
    return F.coalesce(F.concat(character, F.regexp_replace(piece, "^[^;]*;", "")), F.concat(F.lit("&"), piece))


def unescape(c: Column | str) -> Column:
    """Entities to characters; a name or number that stands for none becomes a blank."""

    def pieces_back(pieces: Column) -> Column:
        later = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), _after_ampersand)
        return F.concat(F.get(pieces, F.lit(0)), F.array_join(later, ""))

    return let(_col(c), lambda t: F.when(t.contains("&"), let(F.split(t, "&"), pieces_back)).otherwise(t))


def visible(html: Column | str) -> Column:
    """Visible text of a page with its blanks as they are, enough to find words in."""
    return unescape(F.regexp_replace(_col(html), NOT_TEXT, " "))


def html_text(html: Column | str) -> Column:
    """Visible text of a page, blanks collapsed."""
    return F.trim(F.regexp_replace(visible(html), BLANKS, " "))


def words(text: Column | str, pattern: str = WORD) -> Column:
    """Lower-cased words of a text."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(pattern), F.lit(0))
