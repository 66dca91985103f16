"""Cleaning and normalisation of posting descriptions.

Patterns carry ``(?U)`` so that letters, digits and whitespace are meant in the Unicode
sense, and ``(?d)`` with ``(?m)`` so that only a newline ends a line.
"""

from __future__ import annotations

import html
import re
import string
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from vacancylake.functions.arrays import let
from vacancylake.functions.entities import unescape

# Whitespace inside a character class under (?U): the Unicode property and the four ASCII
# information separators.
SPACE = r"\s\x1c-\x1f"
#: The Unicode property as a class of Python's patterns.
BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# Markers, tags and patterns that define the cleaned text.
BULLETS = "•·▪▫◦‣⁃"
BULLET = "• "
LINE_TAGS = [r"<br(?U:\s)*/?>", r"</?p[^>]*>", r"</?div[^>]*>"]
ITEM_TAG = r"</?li[^>]*>"
LIST_TAGS = [r"</?ul[^>]*>", r"</?ol[^>]*>"]
#: All of these but the items at once, so that places without ``<`` cost one look.
BREAKING_TAG = r"<(?:br(?U:\s)*/?|/?(?:p|div|ul|ol)[^>]*)>"
ANY_TAG = r"<[^>]+>"
EMAIL_OR_URL = (
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b|https?://[^\s]+|www\.[^\s]+"
)
KEPT_CHARACTERS = r"""\w\s.,!?\-:;()\[\]"'/+=@#$%&*"""
SECTION_HEADERS = {
    "requirements": r"requirements?|qualifications?|skills?",
    "responsibilities": r"responsibilities?|duties|role",
    "benefits": r"benefits?|perks?|we offer",
    "about": r"about us|company|who we are",
    "description": r"job description|role description|overview",
}


@cache
def characters(kinds: tuple[str, ...]) -> str:
    """The inside of a character class: code points whose category begins with one of ``kinds``."""
    ranges: list[list[int]] = []
    for code in range(sys.maxunicode + 1):
        if unicodedata.category(chr(code)).startswith(kinds):
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


#: Texts are searched together up to about so many bytes, which a processor's cache holds.
CHUNK_BYTES = 1 << 18
_ARROW_TYPES = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64()), "array<array<int>>": pa.list_(pa.list_(pa.int32()))}


def per_batch(function: Callable[[list[bytes]], list], returns: str, *, null: bytes | None = None) -> Callable[[Column], Column]:
    """A function of a list of texts as a column function; NULL is read as the text ``null`` or stays NULL.

    Texts come as UTF-8, invalid ones with replacements as the JVM decodes them.  The column stays a string until
    it is here, so that functions of results of others follow each other in one pass.  Each call gets about
    ``CHUNK_BYTES`` of texts.  The function is sent by value, so executors need not be able to import it.
    """

    def chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
        first = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= most:
                yield texts[first : i + 1]
                first, size = i + 1, 0
        if first < len(texts):
            yield texts[first:]

    def run(texts: pa.Array) -> pa.Array:
        found: list = []
        coded = [null if t is None else t for t in texts.cast(pa.binary()).to_pylist()]
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            coded = [None if t is None else t.decode("utf-8", "replace").encode() for t in coded]
        for chunk in chunks([t or b"" for t in coded]):
            found += function(chunk)
        if null is None:
            found = [None if t is None else f for t, f in zip(coded, found)]
        return pa.array(found, kind)

    kind, most = _ARROW_TYPES[returns], CHUNK_BYTES
    return lambda text: F.arrow_udf(run, returns)(text)


def computed_once(text: Column) -> Column:
    """``text``, empty for NULL, for several functions of ``per_batch``: each would compute the one that made it again."""
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Drop leading and trailing whitespace of any kind."""
    return F.regexp_replace(text, rf"(?U)^[{SPACE}]+|[{SPACE}]+\z", "")


def longer_than(text: Column, min_length: int) -> Column:
    """The stripped text has at least ``min_length`` (two or more) characters; NULL counts as short."""
    return F.coalesce(text.rlike(rf"(?sU)[^{SPACE}].{{{min_length - 2},}}?[^{SPACE}]"), F.lit(False))


def has_text(text: Column) -> Column:
    """The field is present and not the empty string."""
    return text.isNotNull() & (text != "")


def text_or_null(text: Column) -> Column:
    """Stripped text; blank becomes NULL."""
    return F.nullif(strip(text), F.lit(""))


def preview(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def _replace_tags(text: Column, line_tags: list[str], list_tags: list[str]) -> Column:
    for tag in line_tags:
        text = F.regexp_replace(text, "(?i)" + tag, "\n")
    text = F.regexp_replace(text, "(?i)" + ITEM_TAG, "\n" + BULLET)
    for tag in list_tags:
        text = F.regexp_replace(text, "(?i)" + tag, "\n")
    return F.regexp_replace(text, ANY_TAG, " ")


def tags_to_layout(text: Column) -> Column:
    """Block tags become line breaks, list items bullets on lines of their own, others a space."""
    # The order of the tags only matters where one sits inside another's angle brackets.
    def replaced(t: Column) -> Column:
        return F.when(
            t.rlike("<[^>]*<"), _replace_tags(t, LINE_TAGS, LIST_TAGS)
        ).otherwise(_replace_tags(t, [BREAKING_TAG], []))

    # No tag ends behind the last ">", so what follows it isn't searched.
    def parted(t: Column, rest: Column) -> Column:
        return F.concat(let(F.left(t, F.length(t) - F.length(rest)), replaced), rest)

    return let(text, lambda t: let(F.substring_index(t, ">", -1), lambda rest: parted(t, rest)))


def symbol_bullets(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?mdU)^[{SPACE}]*[{BULLETS}][{SPACE}]*", BULLET)


def numbered_bullets(text: Column) -> Column:
    """``1.``, ``a)`` and ``a.`` followed by whitespace at the start of a line."""
    return F.regexp_replace(text, rf"(?mdU)^[{SPACE}]*(?:\d+\.|\w\)|\w\.)[{SPACE}]+", BULLET)


def remove_special(text: Column) -> Column:
    """Characters outside letters, digits and common punctuation become spaces.

    Emails and URLs keep all their characters.
    """
    kept, pattern = f"[{KEPT_CHARACTERS}]", EMAIL_OR_URL
    pieces = F.regexp_extract_all(
        text, F.lit(f"(?sU)(?:{pattern})|(?:(?!{pattern}){kept})+|."), F.lit(0)
    )
    return F.array_join(
        F.transform(
            pieces,
            lambda p: F.when(p.rlike(rf"(?sU)\A[^{KEPT_CHARACTERS}]\z"), F.lit(" ")).otherwise(p),
        ),
        "",
    )


def collapse_whitespace(text: Column) -> Column:
    """Runs of whitespace become one space."""
    # Single spaces before a word are most of the whitespace and stay as they are.
    return F.regexp_replace(text, rf"(?U)(?! [^{SPACE}])[{SPACE}]+", " ")


def tidy_lines(text: Column) -> Column:
    """Strip every line and drop the blank ones."""
    return strip(F.regexp_replace(text, rf"(?U)[{SPACE}]*\n[{SPACE}]*", "\n"))


def tidy_punctuation(text: Column) -> Column:
    """No space before punctuation, one space between a sentence end and a capital."""
    text = F.regexp_replace(text, rf"(?U)[{SPACE}]+(?=[,.!?;:])", "")
    return F.regexp_replace(text, rf"(?U)([.!?])[{SPACE}]*(?=[A-Z])", "$1 ")


def _tidy_line(text: Column) -> Column:
    """``tidy_punctuation`` for text whose only whitespace is single spaces."""
    text = F.regexp_replace(text, " (?=[,.!?;:])", "")
    return F.regexp_replace(text, "[.!?](?=[A-Z])", "$0 ")


#: ``\\w`` of the patterns above as a class: with marks, connectors, joiners and lettered signs.
WORD_KINDS = ("L", "M", "Nd", "Nl", "Pc")
WORD_SIGNS = r"\u200c\u200d\u24b6-\u24e9\U0001f130-\U0001f149\U0001f150-\U0001f169\U0001f170-\U0001f189"


def beyond_ascii() -> Callable[[bytes], set[str]]:
    """A function that lists the different characters of a text that aren't ASCII; a byte that no text has may be there."""
    others = bytes([*range(128), 255])
    return lambda coded: set(coded.translate(None, others).decode())


def spacer() -> Callable[[bytes], bytes]:
    """A function that puts blanks in the place of whitespace of any kind; bytes that no text has are let through."""
    others = beyond_ascii()
    table = bytes(32 if i < 128 and chr(i).isspace() else i for i in range(256))

    def spaced(coded: bytes) -> bytes:
        for c in others(coded):
            if c.isspace():
                coded = coded.replace(c.encode(), b" ")
        return coded.translate(table)

    return spaced


@cache
def line_tidier() -> Callable[[list[str]], list[bytes]]:
    """A function that makes one tidy line of each text: single blanks, none before punctuation, one before capitals.

    All texts are one run of bytes meanwhile, parted by one that no text has.
    """
    spaced, part = spacer(), b"\xff"
    goes_before = bytes(c in b" ,.!?;:\xff" for c in range(256))
    ends, capitals = bytes(c in b".!?" for c in range(256)), bytes(c in string.ascii_uppercase.encode() for c in range(256))

    def where(coded: bytes, table: bytes) -> np.ndarray:
        return np.frombuffer(coded.translate(table), np.bool_)

    def tidied(texts: list[str]) -> list[bytes]:
        coded = spaced(part.join(t.encode() for t in texts)) + part
        signs = np.frombuffer(coded, np.uint8)
        kept = signs != 32
        kept[:-1] |= ~where(coded, goes_before)[1:]
        coded = signs[kept].tobytes()
        at = np.flatnonzero(where(coded, ends)[:-1] & where(coded, capitals)[1:])
        if len(at):
            coded = np.insert(np.frombuffer(coded, np.uint8), at + 1, 32).tobytes()
        return [t.lstrip(b" ") for t in coded[:-1].split(part)]

    return tidied


@cache
def line_cleaner(min_length: int = 0) -> Callable[[list[bytes]], list[bytes]]:
    """What ``clean`` does to texts that become one line each, step by step as the functions above.

    Plain searches and splits of whole texts take a fraction of the time of a pattern tried at each sign.
    """
    blank = BLANK

    def tag(pattern: str) -> re.Pattern:
        # ASCII letters of either case, nothing that only folds to them
        letters = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", pattern.replace(r"(?U:\s)", "@"))
        return re.compile(letters.replace("@", blank))

    line_tags, list_tags = [tag(t) for t in LINE_TAGS], [tag(t) for t in LIST_TAGS]
    breaking, item, any_tag, nested = tag(BREAKING_TAG), tag(ITEM_TAG), re.compile(ANY_TAG), re.compile("<[^>]*<")

    def bulleted(marker: str, spaces: str) -> re.Pattern:
        # a line break stands before the text; a marker right behind the blanks of another one may begin a line too
        return re.compile(rf"\n\s*(?:{marker})\s{spaces}(?:(?<=\n)(?:{marker})\s{spaces})*")

    def numbered(word: str) -> re.Pattern:
        return bulleted(rf"\d+\.|[{word}][).]", "+")

    symbols = bulleted(f"[{BULLETS}]", "*")
    numbers, other_numbers = numbered("A-Za-z0-9_"), numbered(characters(WORD_KINDS) + WORD_SIGNS)
    bullet, new_item = BULLET, "\n" + BULLET
    decoded, tidied = html.unescape, line_tidier()

    def replaced(t: str) -> str:
        if nested.search(t):
            for pattern in line_tags:
                t = pattern.sub("\n", t)
            t = item.sub(new_item, t)
            for pattern in list_tags:
                t = pattern.sub("\n", t)
        else:
            t = item.sub(new_item, breaking.sub("\n", t))
        return any_tag.sub(" ", t)

    def bullets(found: re.Match) -> str:
        return "\n" + bullet * len(found[0].split())

    def laid_out(t: str) -> str:
        if len(t.strip()) < min_length:
            return ""
        if "<" in t or "&" in t:
            head, end, rest = decoded(t).rpartition(">")
            t = replaced(head + end) + rest
        t = "\n" + t
        if t.isascii():
            return numbers.sub(bullets, t)
        return other_numbers.sub(bullets, symbols.sub(bullets, t))

    return lambda texts: tidied([laid_out(t.decode()) for t in texts])


def clean(
    text: Column,
    *,
    remove_html: bool = True,
    remove_special_chars: bool = False,
    normalize_whitespace: bool = True,
    min_length: int = 10,
) -> Column:
    """Cleaned description; ``""`` for NULL or text shorter than ``min_length``.

    With ``normalize_whitespace=False`` line breaks stay, which the section functions need.
    """
    if remove_html and normalize_whitespace and not remove_special_chars:
        return per_batch(line_cleaner(min_length), "string", null=b"")(text)
    result = unescape(text)
    if remove_html:
        # Entities may decode to tags, so only text with neither sign is free of them.
        marked = F.contains(text, F.lit("<")) | F.contains(text, F.lit("&"))
        result = F.when(marked, tags_to_layout(result)).otherwise(text)
    result = numbered_bullets(symbol_bullets(result))
    if remove_special_chars:
        result = remove_special(result)
    if normalize_whitespace:
        # One line is left, so stripping spaces is all that tidying lines would do.
        result = _tidy_line(F.trim(collapse_whitespace(result)))
    else:
        result = strip(tidy_punctuation(tidy_lines(result)))
    return F.when(longer_than(text, min_length), result).otherwise(F.lit(""))


def normalize(text: Column) -> Column:
    """Lower case, separators to spaces, whitespace collapsed."""
    return strip(collapse_whitespace(F.regexp_replace(F.lower(text), r"[/\-_.]", " ")))


@cache
def words_finder() -> Callable[[list[bytes]], bytes]:
    """A function that leaves only the lower-case words of letters, marks, numbers, ``+`` and ``#`` of texts, blanks between.

    The texts are one run of bytes afterwards, each with a zero behind it.  ASCII is lowered and parted by one table;
    of other characters each different one is looked at once.
    """
    lower, kinds = string.ascii_lowercase + string.digits + "+#", "LMN"
    kept = {0: 0, **{i: ord(chr(i).lower()) for i in range(128) if chr(i).lower() in lower}}
    table = bytes(kept.get(i, 32) if i < 128 else i for i in range(256))
    others, category, sigma = beyond_ascii(), unicodedata.category, "Σ".encode()

    def formed(c: str) -> bytes:
        """A character in lower case, or as many blanks as it has bytes."""
        small = c.lower() if category(c.lower()[0])[0] in kinds else " " * len(c.encode())
        return small.encode()

    def found(texts: list[bytes]) -> bytes:
        coded = b"\0".join(texts)
        if coded.count(b"\0") >= len(texts):
            coded = b"\0".join([t.replace(b"\0", b" ") for t in texts])
        if not coded.isascii():
            forms = {c.encode(): formed(c) for c in others(coded)}
            if any(len(c) != len(f) or c == sigma for c, f in forms.items()):
                # what is as long in lower case, wherever it stands, is left
                coded = coded.decode().lower().encode()
                forms = {c.encode(): formed(c) for c in others(coded)}
            signs = np.frombuffer(bytearray(coded), np.uint8)
            places = np.flatnonzero(signs >= 128)
            apart = signs[places].tobytes()
            for c, f in forms.items():
                if c != f:
                    apart = apart.replace(c, f)
            signs[places] = np.frombuffer(apart, np.uint8)
            coded = signs.tobytes()
        return coded.translate(table) + b"\0"

    return found


@cache
def word_places() -> Callable[[bytes], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A function of what ``words_finder`` left: where words begin and end, and the number of each text's first word, and of the end."""

    def placed(coded: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        signs = np.frombuffer(coded, np.uint8)
        inside = np.zeros(len(signs) + 1, np.bool_)
        np.greater(signs, 32, out=inside[1:])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begins, ends = edges[::2], edges[1::2]
        first = np.searchsorted(begins, np.flatnonzero(signs == 0))
        return begins, ends, np.concatenate(([0], first))

    return placed


def match_form(text: Column) -> Column:
    """Text as terms are compared: its ``match_words``, parted by one space."""
    found = words_finder()

    def formed(texts: list[bytes]) -> list[bytes]:
        coded = found(texts)
        while b"  " in coded:
            coded = coded.replace(b"  ", b" ")
        return [t.strip(b" ") for t in coded[:-1].split(b"\0")]

    return per_batch(formed, "string")(text)


def match_words(text: Column) -> Column:
    """Lower-case words of letters, digits, ``+`` and ``#``."""
    # a text without any word has the empty form, which is no word
    return let(match_form(text), lambda form: F.array_remove(F.split(form, " "), ""))


def _section(text: Column, headers: str) -> Column:
    pattern = rf"(?isdU)(?:{headers})\s*:?\s*\n(.*?)(?=\n(?:[A-Z][^:]*:|$))"
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0))


def sections(text: Column) -> Column:
    """Struct of the five usual sections of a text with its line breaks; absent ones are NULL."""
    return F.struct(*[strip(_section(text, h)).alias(n) for n, h in SECTION_HEADERS.items()])


def requirements_section(text: Column) -> Column:
    return _section(text, SECTION_HEADERS["requirements"] + r"|must\s*have")


def word_count(text: Column) -> Column:
    spaced = spacer()

    def counted(texts: list[bytes]) -> list[int]:
        coded = spaced(b"\xff".join(texts) + b"\xff")
        signs = np.frombuffer(coded, np.uint8)
        blank = (signs == 32) | (signs == 255)
        begins = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
        if not blank[0]:
            begins = np.concatenate(([0], begins))
        upto = np.searchsorted(begins, np.flatnonzero(signs == 255))
        return np.diff(upto, prepend=0).tolist()

    return per_batch(counted, "int")(text)


def cleaning_stats(original: Column, cleaned: Column) -> Column:
    """Lengths, word counts and the share of text removed (0 when there was none)."""
    ratio = F.when(F.length(original) > 0, 1 - F.length(cleaned) / F.length(original))
    return F.struct(
        F.length(original).alias("original_length"),
        F.length(cleaned).alias("cleaned_length"),
        F.coalesce(ratio, F.lit(0.0)).alias("reduction_ratio"),
        F.coalesce(word_count(original), F.lit(0)).alias("original_words"),
        F.coalesce(word_count(cleaned), F.lit(0)).alias("cleaned_words"),
    )
