"""Rule extraction: contacts, dates, durations, salaries, arrangements, education.

Each kind is a list of patterns applied in order; hits are concatenated and deduplicated,
first hit first.  A pattern names what its matches begin with.  These places are found for many
texts at once, and the pattern is tried there alone.  It is tried on signs of one byte, of which
each character has one: ASCII letters in lower case, and for all others what patterns ask of them.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable
from functools import cache
from itertools import accumulate
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from vacancylake.functions.text import BLANK, WORD_KINDS, WORD_SIGNS, computed_once, per_batch, requirements_section, strip


class Rule(NamedTuple):
    pattern: str
    begins: tuple[str, ...]  # what a match begins with, in lower case, _DIGIT for any digit
    needs: tuple[str, ...] = ()  # literals of which a text must hold one, in lower case
    before: str = ""  # class of the characters a match has before what it "begins" with


# The patterns that define each extracted kind.
_DAY = r"\d{1,2}"
_MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
    "|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
)
_URL_TAIL = r'[^\s<>"{}|\\^`\[\]]+'
_DIGIT = r"\d"
_MAILBOX = "[A-Za-z0-9._%+-]"
# "degree" or nothing; a word boundary may follow after spaces that are not part of the hit.
_DEGREE = r"(?:\s*degree\b|(?=\s*\b))"
RULES: dict[str, list[Rule]] = {
    "dates": [
        Rule(rf"\b{_DAY}[/-]{_DAY}[/-]\d{{4}}\b", (_DIGIT,), ("/", "-")),
        Rule(rf"\b{_DAY}\.{_DAY}\.\d{{4}}\b", (_DIGIT,), (".",)),
        Rule(rf"\b(?:{_MONTHS})\s+\d{{4}}\b", tuple(_MONTHS.lower().split("|")[12:])),
        Rule(
            r"\b(?:immediately|asap|urgent|within\s+\d+\s+(?:days?|weeks?|months?))\b",
            ("immediately", "asap", "urgent", "within"),
            ("immediately", "asap", "urgent", "within"),
        ),
    ],
    "durations": [
        Rule(
            r"\b\d+[-+]?\s*(?:to\s+\d+\s*)?years?\s*(?:of\s*)?(?:experience|exp)\b",
            (_DIGIT,),
            ("year",),
        ),
        Rule(r"\b\d+\s*[-–]\s*\d+\s*years?\b", (_DIGIT,), ("year",)),
        Rule(r"\b\d+\+?\s*years?\b", (_DIGIT,), ("year",)),
        Rule(
            r"\b\d+[-+]?\s*(?:to\s+\d+\s*)?months?\s*(?:of\s*)?(?:experience|exp)\b",
            (_DIGIT,),
            ("month",),
        ),
        Rule(
            r"\b(?:\d+\s*(?:month|year)s?\s*contract|contract\s*(?:for\s*)?\d+\s*(?:month|year)s?)\b",
            (_DIGIT, "contract"),
            ("contract",),
        ),
    ],
    "emails": [Rule(rf"\b{_MAILBOX}+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b", ("@",), ("@",), _MAILBOX)],
    "urls": [
        Rule(rf"https?://{_URL_TAIL}", ("http",), ("://",)),
        Rule(rf"www\.{_URL_TAIL}", ("www.",), ("www.",)),
    ],
    "phone_numbers": [
        Rule(r"\(\d{3}\)\s*\d{3}[-\s]?\d{4}\b", ("(",), ("(",)),
        Rule(r"\b\d{3}[-\s]?\d{3}[-\s]?\d{4}\b", (_DIGIT,)),
        Rule(r"\+\d{1,3}[-\s]?\d{1,4}[-\s]?\d{1,4}[-\s]?\d{1,9}", ("+",), ("+",)),
        Rule(r"(?:\+84|0)\d{9,10}\b", ("0", "+84"), ("0", "+84")),
    ],
    "salaries": [
        Rule(
            r"\$\d{1,3}(?:,\d{3})*(?:\s*[-–]\s*\$?\d{1,3}(?:,\d{3})*)?"
            r"(?:\s*(?:USD|per\s*year|annually|pa))?",
            ("$",),
            ("$",),
        ),
        Rule(r"\$\d{1,3}k(?:\s*[-–]\s*\$?\d{1,3}k)?", ("$",), ("$",)),
        Rule(
            r"\b\d{1,3}k?\s*[-–]\s*\d{1,3}k?\s*(?:USD|dollars?|per\s*year|annually)\b",
            (_DIGIT,),
            ("usd", "dollar", "per", "annually"),
        ),
        Rule(
            r"\b\d{1,3}(?:\s*[-–]\s*\d{1,3})?\s*(?:triệu|tr|million)\s*(?:VND|đồng)?\b",
            (_DIGIT,),
            ("tr", "million"),
        ),
        Rule(r"\$\d{1,3}(?:\s*[-–]\s*\$?\d{1,3})?\s*(?:per\s*hour|/hour|/hr|hourly)", ("$",), ("$",)),
    ],
    "work_arrangements": [
        Rule(
            r"\b(?:remote|work\s*from\s*home|wfh|telecommute|telework)\b",
            ("remote", "work", "wfh", "telecommute", "telework"),
            ("remote", "home", "wfh", "tele"),
        ),
        Rule(r"\b(?:hybrid|flexible|mixed)\b", ("hybrid", "flexible", "mixed"), ("hybrid", "flexible", "mixed")),
        Rule(
            r"\b(?:on-site|onsite|office|in-person)\b",
            ("on-site", "onsite", "office", "in-person"),
            ("on-site", "onsite", "office", "in-person"),
        ),
        Rule(r"\b(?:full-time|fulltime|full\s*time|ft)\b", ("full", "ft"), ("full", "ft")),
        Rule(r"\b(?:part-time|parttime|part\s*time|pt)\b", ("part", "pt"), ("part", "pt")),
        Rule(
            r"\b(?:contract|contractor|freelance|temporary|temp)\b",
            ("contract", "freelance", "temp"),
            ("contract", "freelance", "temp"),
        ),
    ],
    # The bare words "ba", "ma" and "as" only count before "degree".
    "education_levels": [
        Rule(
            r"\b(?:(?:bachelor'?s?|bs|undergraduate)" + _DEGREE + r"|ba\s*degree\b)",
            ("bachelor", "bs", "undergraduate", "ba"),
            ("bachelor", "bs", "undergraduate", "degree"),
        ),
        Rule(
            r"\b(?:(?:master'?s?|ms|mba|graduate)" + _DEGREE + r"|ma\s*degree\b)",
            ("master", "ms", "mba", "graduate", "ma"),
            ("master", "ms", "mba", "graduate", "degree"),
        ),
        Rule(r"\b(?:phd|ph\.d|doctorate|doctoral)" + _DEGREE, ("phd", "ph.d", "doctor"), ("phd", "ph.d", "doctor")),
        Rule(
            r"\b(?:(?:associate'?s?|aa)" + _DEGREE + r"|as\s*degree\b)",
            ("associate", "aa", "as"),
            ("associate", "aa", "degree"),
        ),
        Rule(r"\b(?:high\s*school|diploma|ged)\b", ("high", "diploma", "ged"), ("high", "diploma", "ged")),
    ],
}
CASE_SENSITIVE = {"phone_numbers"}
IN_LOWER_CASE = {"work_arrangements", "education_levels"}
# Kinds that can be switched off; durations and education are always extracted.
OPTIONAL_KINDS = ["dates", "emails", "urls", "phone_numbers", "salaries", "work_arrangements"]


#: Signs of characters beyond ASCII: of words, of none, digits, whitespace, and those that patterns name; one between texts.
_WORD_SIGN, _OTHER_SIGN, _DIGIT_SIGN, _SPACE_SIGN, _END_SIGN = 0x80, 0x81, 0x82, 0x87, 0xFF
_NAMED_SIGNS = {"–": 0x83, "ệ": 0x84, "đ": 0x85, "ồ": 0x86}
_SIGN_CLASSES = {_DIGIT: "0-9\x82", r"\s": "\t-\r \x87"}
_WORD_CLASS = "[0-9a-z_\x80\x82\x84-\x86]"
_WORD_BOUNDARY = f"(?:(?<={_WORD_CLASS})(?!{_WORD_CLASS})|(?<!{_WORD_CLASS})(?={_WORD_CLASS}))"


def _of_signs(pattern: str) -> bytes:
    """The pattern as it is tried on the signs of texts."""
    out, inside = "", False
    for token in re.findall(r"\\.|\[\^|.", pattern.lower()):
        if token in _SIGN_CLASSES:
            out += _SIGN_CLASSES[token] if inside else f"[{_SIGN_CLASSES[token]}]"
        elif token == r"\b":
            out += _WORD_BOUNDARY
        else:
            inside = token[0] == "[" or inside and token != "]"
            out += "[^\xff" if token == "[^" else chr(_NAMED_SIGNS.get(token, 0)) if token in _NAMED_SIGNS else token
    return out.encode("latin-1")


def _signs(in_lower_case: bool) -> Callable[[list[str]], bytes]:
    """A function that puts the signs of texts in a row, with one more behind each text.

    Patterns match letters in either case, and what only folds to them.  ``in_lower_case`` they are
    for texts that were lowered before, where a dotted capital I has become two characters.
    """
    folded = {"ſ": "s", "\u212a": "k", "ı": "i", **({} if in_lower_case else {"İ": "i"})}
    special = {c: ord(f) for c, f in folded.items()} | {form: sign for c, sign in _NAMED_SIGNS.items() for form in (c, c.upper())}
    blank, letters, kinds = re.compile(BLANK), re.compile(f"[{WORD_SIGNS}]"), WORD_KINDS
    word, other, digit, space, end = _WORD_SIGN, _OTHER_SIGN, _DIGIT_SIGN, _SPACE_SIGN, _END_SIGN
    category, table = unicodedata.category, np.zeros(0, np.uint8)

    def sign(c: str) -> int:
        if c in special or blank.match(c):
            return special.get(c, space)
        kind = category(c)
        if kind == "Nd":
            return digit
        return word if kind.startswith(kinds) or letters.match(c) else other

    def signed(texts: list[str]) -> bytes:
        nonlocal table
        joined = "\n".join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        if not len(table):
            table = np.zeros(0x110000, np.uint8)
            table[:128] = np.frombuffer(b"\1" + bytes(range(1, 128)).lower(), np.uint8)
        signs = table[points]
        for c in set(points[signs == 0].tolist()):
            table[c] = sign(chr(c))
            signs[points == c] = table[c]
        signs[np.cumsum([len(t) + 1 for t in texts]) - 1] = end
        return signs.tobytes()

    return signed


@cache
def finder(kind: str) -> Callable[[list[bytes]], list[list[str]]]:
    """A function of texts that lists the distinct hits of a kind in each."""
    rules, lower, phones = RULES[kind], kind in IN_LOWER_CASE, kind == "phone_numbers"
    patterns = [re.compile(_of_signs(r.pattern)) for r in rules]
    needed, bounded = [r.needs for r in rules], [r.pattern.startswith(r"\b") and not r.before for r in rules]
    by_digit = [bounded[i] and _DIGIT in r.begins for i, r in enumerate(rules)]
    literals = [() if bounded[i] else tuple(b.encode() for b in r.begins) for i, r in enumerate(rules)]
    before = [re.compile(_of_signs(r.before)).fullmatch if r.before else None for r in rules]
    signed, blanks, end = _signs(lower), re.compile(BLANK + "+"), bytes([_END_SIGN])
    word = re.compile(_WORD_CLASS.encode("latin-1"))
    words = bytes(word.match(bytes([c])) is not None for c in range(256))
    digits = bytes(chr(c) in "0123456789" or c == _DIGIT_SIGN for c in range(256))
    #: By a hash of the first three signs of a word the rules, one to a bit, that it may begin a match of.
    starts, bits, factor = np.zeros(1 << 16, np.uint8), np.uint32(16), np.uint32(0x9E3779B1)

    def slots(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
        code = first.astype(np.uint32) | second.astype(np.uint32) << np.uint32(8) | third.astype(np.uint32) << np.uint32(16)
        return (code * factor) >> bits

    for i, rule in enumerate(rules):
        for literal in [b.encode() for b in rule.begins if bounded[i] and b != _DIGIT]:
            third = np.arange(256) if len(literal) == 2 else np.array([literal[2]])
            starts[slots(np.full(len(third), literal[0]), np.full(len(third), literal[1]), third)] |= np.uint8(1 << i)
    by_word = bool(starts.any())

    def places(signs: bytes, literal: bytes) -> list[int]:
        out, at = [], signs.find(literal)
        while at >= 0:
            out.append(at)
            at = signs.find(literal, at + 1)
        return out

    def candidates(signs: bytes) -> list[list[int]]:
        """Where matches of each rule may begin, in order; where its literal stands if something may be before it."""
        out: list[list[int]] = [sorted(p for b in of for p in places(signs, b)) for of in literals]
        if any(bounded):
            inside = np.frombuffer(signs.translate(words), np.bool_)
            begun = inside.copy()
            begun[1:] &= ~inside[:-1]
            numbers = np.flatnonzero(begun & np.frombuffer(signs.translate(digits), np.bool_)).tolist() if any(by_digit) else []
            if by_word:
                row, at = np.frombuffer(signs + end + end, np.uint8), np.flatnonzero(begun)
                may = starts[slots(row[at], row[at + 1], row[at + 2])]
                at, may = at[may > 0], may[may > 0]
            for i in range(len(out)):
                if bounded[i]:
                    of = at[(may >> np.uint8(i)) & np.uint8(1) == 1].tolist() if by_word else []
                    out[i] = sorted(of + numbers) if by_digit[i] and of else numbers if by_digit[i] else of
        return out

    def spans(signs: bytes, pattern: re.Pattern, held, at: list[int]) -> list[tuple[int, int]]:
        out, last = [], 0
        for place in at:
            if place < last:
                continue
            if held is None:
                found = pattern.match(signs, place)
            else:
                begin = place
                while begin > last and held(signs, begin - 1, begin):
                    begin -= 1
                # at the first place of a word boundary, since what follows the literal is the same for all
                while begin < place and bool(words[signs[begin]]) == bool(begin and words[signs[begin - 1]]):
                    begin += 1
                found = pattern.match(signs, begin) if begin < place else None
            if found:
                last = found.end()
                out.append((found.start(), last))
        return out

    def hits(coded: list[bytes]) -> list[list[str]]:
        texts = [t.decode() for t in coded]
        signs = end.join([*coded, b""]).lower() if all(map(bytes.isascii, coded)) else signed(texts)
        first = [0, *accumulate(len(t) + 1 for t in texts)]
        out: list[dict[str, None]] = [{} for _ in texts]
        for pattern, held, needs, at in zip(patterns, before, needed, candidates(signs)):
            for begin, stop in spans(signs, pattern, held, at):
                number = bisect_right(first, begin) - 1
                text, offset = texts[number], first[number]
                hit = text[begin - offset : stop - offset]
                low = hit.lower().replace("ſ", "s")
                if needs and not any(n in low for n in needs):
                    all_low = text.lower().replace("ſ", "s")
                    if not any(n in all_low for n in needs):
                        continue
                out[number][blanks.sub("-", hit) if phones else low if lower else hit] = None
        return [list(found) for found in out]

    return hits


def lowered(text: Column) -> Column:
    """Lower-case text in which the literals of the rules are looked up.

    Case-insensitive patterns take the long s for an s, so it counts as one here too.
    """
    return F.replace(F.lower(text), F.lit("ſ"), F.lit("s"))


def extract(text: Column, kind: str, lower: Column | None = None) -> Column:
    """Distinct hits of one kind, in pattern order and then text order.

    ``lower``, which is ``lowered(text)``, may be given; the batches lower texts by themselves.
    """
    return per_batch(finder(kind), "array<string>", null=b"")(text)


def extract_all(
    text: Column, lower: Column | None = None, *, skip: tuple[str, ...] = ()
) -> dict[str, Column]:
    """A column per kind; kinds of ``OPTIONAL_KINDS`` named in ``skip`` are left out."""
    unknown = set(skip) - set(OPTIONAL_KINDS)
    if unknown:
        raise ValueError(f"kinds that cannot be skipped: {sorted(unknown)}")
    return {kind: extract(computed_once(text), kind, lower) for kind in RULES if kind not in skip}


def contact_info(text: Column) -> Column:
    return F.struct(*[extract(computed_once(text), k).alias(k) for k in ("emails", "phone_numbers", "urls")])


def requirements(text: Column) -> Column:
    """The requirements section of a text with line breaks, and what it says; NULL without one."""
    section = requirements_section(text)
    return F.when(
        section.isNotNull(),
        F.struct(
            strip(section).alias("raw_requirements"),
            *[
                extract(section, k).alias(k)
                for k in ("durations", "education_levels", "work_arrangements")
            ],
        ),
    )
