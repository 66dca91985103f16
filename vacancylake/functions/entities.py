"""HTML character references, decoded on the JVM side.

The rules are those of the HTML standard; the names come from the Python standard library.
"""

from __future__ import annotations

import html
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacancylake.functions.arrays import constant
from vacancylake.schemas import STRINGS

# Handled by plain replacement; "&amp;" is last so that each reference is decoded once.
COMMON = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}

_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,31};?)"
_PIECES = _REFERENCE + r"|[^&]+|&"
_UNCOMMON = "&(?!(?:" + "|".join(e[1:-1] for e in COMMON) + ");)[#A-Za-z]"
# Names also valid without a semicolon, longest first, for references run into other text.
_BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_BARE_PREFIX = "^&(" + "|".join(_BARE) + ")"
# Code points 0x80-0x9F stand for their Windows-1252 characters.
_WINDOWS_1252 = [html.unescape(f"&#{n};") for n in range(0x80, 0xA0)]
_REPLACEMENT = "�"
_LAST_CODE_POINT = 0x10FFFF


def _names() -> Column:
    return constant(html5, T.MapType(T.StringType(), T.StringType()))


def _character(code: Column) -> Column:
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    dropped = (
        code.between(0x1, 0x8)
        | (code == 0xB)
        | code.between(0xE, 0x1F)
        | (code == 0x7F)
        | code.between(0xFDD0, 0xFDEF)
        | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    )
    return (
        F.when(
            code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > _LAST_CODE_POINT),
            F.lit(_REPLACEMENT),
        )
        .when(code.between(0x80, 0x9F), F.get(constant(_WINDOWS_1252, STRINGS), (code - 0x80).cast("int")))
        .when(dropped, F.lit(""))
        .otherwise(plain)
    )


def _numeric(piece: Column) -> Column:
    digits = F.regexp_extract(piece, r"^&#[xX]?0*([0-9a-fA-F]*);?$", 1)
    base16 = piece.rlike("^&#[xX]")
    # Anything longer than these cannot be a code point; NULL stands for "out of range".
    code = F.when(base16 & (F.length(digits) <= 8), F.conv(F.concat(F.lit("0"), digits), 16, 10)).when(
        ~base16 & (F.length(digits) <= 10), F.concat(F.lit("0"), digits)
    )
    return _character(code.cast("bigint"))


def _named(piece: Column) -> Column:
    name = F.substring(piece, 2, 64)
    bare = F.regexp_extract(piece, _BARE_PREFIX, 1)
    return F.coalesce(
        F.element_at(_names(), name),
        F.when(
            bare != "",
            F.concat(F.element_at(_names(), bare), F.substr(piece, F.length(bare) + 2)),
        ),
        piece,
    )


def unescape(text: Column) -> Column:
    """Decode named and numeric character references; other text is unchanged."""
    common = text
    for reference, character in COMMON.items():
        common = F.replace(common, F.lit(reference), F.lit(character))
    decoded = F.array_join(
        F.transform(
            F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)),
            lambda piece: F.when(piece.startswith("&#") & (F.length(piece) > 2), _numeric(piece))
            .when(piece.startswith("&") & (F.length(piece) > 1), _named(piece))
            .otherwise(piece),
        ),
        "",
    )
    return (
        F.when(~F.contains(text, F.lit("&")), text)
        .when(text.rlike(_UNCOMMON), decoded)
        .otherwise(common)
    )
