"""Text columns: HTML clean-up, chunking, tokens, titles, windows, prompts."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from html import unescape
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column, functions as F

from folioscope import config

# Fixed patterns. Java needs (?U) so that \w and \s follow Unicode.
WORD = r"(?U)\b\w+\b"
TOKEN = r"(?U)\w+|[^\w\s]"
EDGE_SPACE = r"(?U)^\s+|\s+$"
SPACES = r"(?U)\s+"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def strip(text: Column) -> Column:
    """Remove whitespace of any kind at both ends."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def is_blank(text: Column) -> Column:
    """True for null and whitespace-only strings."""
    return text.isNull() | (strip(text) == "")


def words(text: Column) -> Column:
    """Lower-case words, repeats kept, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def tokens(text: Column) -> Column:
    """Lower-case words and single punctuation marks, for keyword search."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def split_words(text: Column) -> Column:
    """Split on whitespace, without empty parts."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


# --- HTML -------------------------------------------------------------------

#: What a reference means, by its name or "#" and decimal number: the names of XHTML pages, and the numbers 128 to 159,
#: which stand for the characters of windows-1252.
REFERENCES = {
    **{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'",
    **{f"#{code}": bytes([code]).decode("cp1252") for code in range(128, 160) if code not in (129, 141, 143, 144, 157)},
}
_REFERENCE = r"(?s)^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);(.*)$"


def decode_entities(text: Column) -> Column:
    """Every character reference, named or numeric, decoded once; unknown ones and bare ampersands stay."""
    known = F.from_json(F.lit(json.dumps(REFERENCES)), "map<string,string>")

    def decoded(part):
        name = F.regexp_extract(part, _REFERENCE, 1)
        digits = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.conv(F.substring(name, 2, 7), 10, 10))
        code = digits.cast("int")
        usable = name.startswith("#") & (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        char = F.coalesce(F.try_element_at(known, F.when(name.startswith("#"), F.concat(F.lit("#"), digits)).otherwise(name)), F.when(usable, char))
        return F.when((name == "") | char.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(char, F.regexp_extract(part, _REFERENCE, 2)))

    def whole(parts):
        return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), decoded), ""))

    return F.when(text.contains("&"), bind(F.split(text, "&", -1), whole)).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Readable text of a page: no head, scripts or styles, tidy lines.

    Tags leave nothing behind, so a word with an inline tag in it stays whole; only line ends and runs of spaces part lines.
    """
    x = F.regexp_replace(html, r"<\?xml[^>]+\?>|<!DOCTYPE[^>]+>", "")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", "")
    x = F.regexp_replace(x, r"(?is)<script\b[^>]*>.*?</script\s*>", "")
    x = F.regexp_replace(x, r"(?is)<style\b[^>]*>.*?</style\s*>", "")
    x = F.regexp_replace(x, r"(?is)<head\b[^>]*>.*?</head\s*>", "")
    x = F.regexp_replace(x, r"(?s)</?[a-zA-Z][^>]*>", "")
    x = decode_entities(x)
    phrases = F.flatten(F.transform(F.split(x, r"\r\n|\n|\r"), lambda line: F.split(strip(line), "  ")))
    phrases = F.filter(F.transform(phrases, strip), lambda p: p != "")
    return F.regexp_replace(F.array_join(phrases, "\n"), r"</?[a-z]+[^>]*>", "")


_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^>]*>")
#: Elements without an end tag, and those that are no reason to remove anything though they hold no text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
KEPT_EMPTY = {"img", "br"}


def without_empty_elements(html: str) -> str:
    """``html`` without the elements that hold neither text nor an image, whatever is nested in them.

    One pass with a stack of open elements: an element without end tag ends with the one around it, an end tag without
    start stays. Line breaks outside removed elements stay.
    """
    gone, stack, opened, at = [], [], {}, 0  # stack: [name, start, holds something]; opened: how many of a name are in it

    def close(end):
        _, start, full = stack.pop()
        if full:
            if stack:
                stack[-1][2] = True
        else:
            while gone and gone[-1][0] >= start:
                gone.pop()
            gone.append((start, end))

    for tag in _TAG.finditer(html):
        if stack and not stack[-1][2] and unescape(html[at : tag.start()]).strip():
            stack[-1][2] = True
        at, name = tag.end(), tag[2].lower()
        if tag[1]:
            if opened.get(name):
                while stack[-1][0] != name:
                    opened[stack[-1][0]] -= 1
                    close(tag.start())
                opened[name] -= 1
                close(tag.end())
        elif name == "img":
            if stack:
                stack[-1][2] = True
        elif name not in VOID and not tag[0].endswith("/>"):
            stack.append([name, tag.start(), False])
            opened[name] = opened.get(name, 0) + 1
        elif name not in KEPT_EMPTY:
            gone.append(tag.span())
    if stack and unescape(html[at:]).strip():
        stack[-1][2] = True
    while stack:
        close(len(html))
    kept = zip([0, *(end for _, end in gone)], [*(start for start, _ in gone), len(html)])
    return "".join(html[a:b] for a, b in kept)


def drop_empty_elements(html: Column) -> Column:
    """``without_empty_elements`` on batches of pages; null stays null."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(without_empty_elements, na_action="ignore")

    return run(html)


def normalise_html(html: Column) -> Column:
    """Chapter markup ready for display.

    Drops scripts, styles, comments, inline styles, empty elements and the html/head/
    body wrappers; collapses whitespace; marks internal links; keeps only the file
    name of image sources, with the original in ``data-epub-src``.
    """
    x = F.regexp_replace(html, r"<\?xml[^>]+\?>|<!DOCTYPE[^>]+>", "")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", "")
    x = F.regexp_replace(x, r"(?is)<script\b[^>]*>.*?</script\s*>", "")
    x = F.regexp_replace(x, r"(?is)<style\b[^>]*>.*?</style\s*>", "")
    x = F.regexp_replace(x, r"(?is)<head\b[^>]*>.*?</head\s*>", "")
    x = F.regexp_replace(x, r"(?i)</?(html|body)\b[^>]*>", "")
    x = F.regexp_replace(x, r"(?i)\s+style\s*=\s*(\"[^\"]*\"|'[^']*')", "")
    x = F.regexp_replace(x, r"\s+", " ")
    x = drop_empty_elements(x)
    for quote in "\"'":
        other = f"[^{quote}]"
        x = F.regexp_replace(
            x, rf"(?i)<a\b([^>]*\shref\s*=\s*{quote}(?:#{other}*|{other}*\.x?html{other}*){quote}[^>]*)>", '<a data-internal-link="true"$1>'
        )
        image = rf"(?i)(<img\b[^>]*?\s)src\s*=\s*{quote}((?:{other}*/)?([^{quote}/]*)){quote}"
        x = F.regexp_replace(x, image, f"$1src={quote}$3{quote} data-epub-src={quote}$2{quote}")
    return F.trim(x)


def _attributes(html: Column, tag: str, name: str) -> Column:
    """The values of an attribute in order, whether in double, single or no quotes, with references decoded."""
    value = rf"(?i)<{tag}\b[^>]*?\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
    return F.transform(F.regexp_extract_all(html, F.lit(value), 1), lambda v: decode_entities(F.regexp_replace(v, "^[\"']|[\"']$", "")))


def hrefs(html: Column) -> Column:
    """All link targets of a page in order."""
    return _attributes(html, "a", "href")


def is_internal_link(href: Column) -> Column:
    """Fragment links and links to (x)html files stay inside the book."""
    return href.startswith("#") | href.contains(".html") | href.contains(".xhtml")


def image_sources(html: Column) -> Column:
    return _attributes(html, "img", "src")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _inner_text(html: Column, pattern: str) -> Column:
    found = strip(decode_entities(F.regexp_replace(F.regexp_extract(html, pattern, 1), r"<[^>]+>", "")))
    return F.nullif(found, F.lit(""))


def chapter_title(html: Column, file_name: Column, spine_index: Column) -> Column:
    """First usable title of a chapter.

    In turn: the first heading, the document title, a block marked by id or class (``TITLE_MARKS``), the opening sentence
    of a text that begins like a chapter (``OPENINGS``, ``NUMBERED_OPENINGS``), a number or kind in the file name (a
    number with the rest of the sentence that names it in the text, if there is one), the position.
    """
    body = html_to_text(html)
    numbered = rf"(?:{'|'.join(config.NUMBERED_OPENINGS)})\s+(?:[IVXLCDM]+|[0-9]+)"
    opening = rf"(?i)^(?:{'|'.join([*config.OPENINGS, numbered])})[\s:.]"
    marks = rf"(?:id|class)\s*=\s*[\"'][^\"']*(?:{'|'.join(config.TITLE_MARKS)})[^\"']*[\"']"
    sentence = F.regexp_extract(body, r"^.*?[.!?](?=\s|$)", 0)
    opened = strip(F.coalesce(F.nullif(sentence, F.lit("")), F.regexp_extract(body, opening, 0)))
    name = F.lower(file_name)
    number = F.nullif(F.regexp_extract(name, r"chapter[_\-\s]?(\d+)", 1), F.lit(""))
    heads = F.split(body, r"(?i)\bchapter(?=\s+[0-9])", -1)
    own = F.filter(heads, lambda h: F.regexp_extract(h, r"^\s+([0-9]+)[:.\s]", 1) == number)
    subtitle = strip(F.regexp_extract(F.get(own, 0), r"^\s+[0-9]+[:.\s]+(.*?)[.!?](?=\s|$)", 1))
    kind = F.nullif(F.regexp_extract(name, f"({'|'.join(config.FILE_KINDS)})", 1), F.lit(""))
    return F.coalesce(
        _inner_text(html, r"(?is)<h[1-4]\b[^>]*>(.*?)</h[1-4]\s*>"),
        _inner_text(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>"),
        _inner_text(html, rf"(?is)<(?:div|section)\b[^>]*\s{marks}[^>]*>(.*?)</(?:div|section)"),
        F.when(F.regexp_extract(body, opening, 0) != "", opened),
        F.concat(F.lit("Chapter "), number, F.concat(F.lit(": "), F.nullif(subtitle, F.lit("")))),
        F.concat(F.lit("Chapter "), number),
        F.initcap(kind),
        F.concat(F.lit("Section "), (spine_index + 1).cast("string")),
    )


def publication_year(date: Column) -> Column:
    """Year of a date such as 2001-05-03, 2001/5 or 2001; null if none."""
    first = F.when(date.contains("-"), F.split_part(date, F.lit("-"), F.lit(1))).when(
        date.contains("/"), F.split_part(date, F.lit("/"), F.lit(1))
    ).otherwise(F.substring(date, 1, 4))
    return first.try_cast("int")


# --- chunks -----------------------------------------------------------------


#: What ``(?U)\s`` matches.
SPACE_CHARS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _cut(window: str, size: int) -> int:
    """Length of the next chunk, given up to ``size + 50`` characters of text.

    Prefers the last paragraph break in the second half, then the last sentence
    end, then the plain size.
    """
    half = size // 2
    for mark, slack in (("\n\n", 50), (". ", 30)):
        at = window.rfind(mark, half, size + slack)
        if at > half:
            return at + 2
    return min(size, len(window))


def chunk_pieces(
    text: str | None,
    size: int = config.CHUNK_SIZE,
    overlap: int = config.CHUNK_OVERLAP,
    mode: str = "document",
    min_chars: int = config.MIN_CHUNK_CHARS,
    min_bytes: int = config.MIN_CHAPTER_BYTES,
) -> list[tuple[int, str]]:
    """(position, chunk) of the overlapping chunks of one text, ending at natural breaks.

    ``document`` advances by at least half a chunk and cuts to the end of the
    text; ``stream`` cuts only while 1.5 chunks of text remain and then keeps the
    rest as one last chunk. Blank chunks and those below ``min_chars`` are left out;
    a text without any other chunk, or below ``min_bytes``, is one chunk. Time is
    linear in the length: every step looks at one window.
    """
    if mode not in ("document", "stream"):
        raise ValueError(f"unknown chunk mode {mode!r}")
    text, half, streaming = text or "", size // 2, mode == "stream"
    reach, pos, found = size + (half if streaming else 50), 0, []
    if not text or len(text.encode()) < min_bytes:
        pos = -1
    while pos >= 0:
        window = text[pos : pos + reach]
        whole = streaming and len(window) < reach
        cut = len(window) if whole else _cut(window, size)
        piece = window[:cut].strip(SPACE_CHARS)
        if len(piece) >= max(1, min_chars):
            found.append((pos, piece))
        advance = cut - overlap // 2 if streaming else max(cut - overlap // 2, half)
        pos = -1 if whole or len(window) <= advance else pos + advance
    return found or [(0, text.strip(SPACE_CHARS))]


# --- windows and prompts ----------------------------------------------------


def window_at_location(
    text: Column, location: Column, context: int = 100, chars: int = config.LOCATION_CHARS, first: int = 1
) -> Column:
    """Up to ``context`` characters on both sides of a location counted from ``first``."""
    pos = F.least(F.length(text) - 1, (location - F.lit(first)) * F.lit(chars))
    start = F.greatest(F.lit(0), pos - F.lit(context))
    end = F.least(F.length(text), pos + F.lit(context))
    return F.when(pos < 0, F.lit("")).otherwise(F.substring(text, (start + 1).cast("int"), (end - start).cast("int")))


# The words of an entry are fixed values: replies and figures refer to passages by them.
def passage_block(rank: Column, method: Column, title: Column, location: Column, text: Column) -> Column:
    """One entry of the context block; keyword and expanded hits are marked."""
    marker = F.when(method == "bm25", F.lit("[KW] ")).when(method == "expanded_vector", F.lit("[EX] ")).otherwise(F.lit(""))
    where = F.concat(
        F.lit("(Chapter: "), F.coalesce(title, F.lit("Unknown Chapter")),
        F.lit(", Loc: "), F.coalesce(location.cast("string"), F.lit("Unknown Location")), F.lit("):\n"),
        F.coalesce(text, F.lit("")), F.lit("\n"),
    )
    return F.when(method == "summary", F.concat(F.lit("SUMMARY "), where)).otherwise(
        F.concat(F.lit("PASSAGE "), rank.cast("string"), F.lit(" "), marker, where)
    )


def answer_prompt(context: Column, percentage: Column, question: Column) -> Column:
    """What an answering model is given: the allowed passages, the reader's position, the question."""
    return F.concat(
        F.lit("Passages from the part of the book read so far\n\n"), context,
        F.lit("\n\nPosition of the reader: "), F.format_string("%.1f", percentage),
        F.lit(" percent.\nAnswer from these passages alone, without what comes later.\n\nQuestion: "), question,
    )
