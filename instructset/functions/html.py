"""HTML to text as one column expression, evaluated in the JVM."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from instructset.functions.binding import bind
from instructset.functions.text import strip

# A Unicode noncharacter marks the places where markup stood.
_CUT = "\ufdd0"

_ATTRIBUTES = r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+"""
_MARKUP = (
    "(?is)<(?:"
    + "|".join(
        [
            r"!--.*?(?:-->|\z)",
            rf"(script|style)\b{_ATTRIBUTES}(?<!/)>.*?(?:</\1\s*>|\z)",
            rf"[a-z]{_ATTRIBUTES}>",
            r"/?[a-z][^>]*>",
            r"[!?][^>]*>",
            r"/[^a-z>][^>]*>",
        ]
    )
    + ")"
)
_REFERENCE = r"^(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][-.a-zA-Z0-9]*);?"

# Looked up by linear search, so the frequent names stand first.
_FREQUENT = ["amp", "nbsp", "quot", "lt", "gt", "copy", "reg", "trade", "middot", "bull", "apos"]


def _pairs_literal(table: dict[str, str]) -> Column:
    """A constant map as one literal; the optimizer folds it before execution."""
    return F.str_to_map(
        F.lit("\ufdd1".join(f"{name}\ufdd2{text}" for name, text in table.items())),
        F.lit("\ufdd1"),
        F.lit("\ufdd2"),
    )


def _named_references() -> dict[str, str]:
    known = {name.rstrip(";"): text for name, text in html5.items()}
    return {name: known[name] for name in [*_FREQUENT, *known]}


def _windows_1252() -> dict[str, str]:
    """Numbers 128-159 are read as Windows-1252, as web pages mean them."""
    decoded = {n: bytes([n]).decode("cp1252", "ignore") for n in range(0x80, 0xA0)}
    return {str(n): text for n, text in decoded.items() if text}


def _code_point(number: Column) -> Column:
    valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    encoded = F.unhex(F.lpad(F.hex(number), 8, "0"))
    return F.when(valid, F.decode(F.when(valid, encoded), "UTF-32")).otherwise(F.lit("\ufffd"))


def _resolve(piece: Column) -> Column:
    """``piece`` is the text between two ampersands, the first of which is gone."""
    name = F.regexp_extract(piece, _REFERENCE, 1)
    rest = F.regexp_replace(piece, _REFERENCE, "")
    # Eight digits hold every valid code point; longer numbers are invalid anyway.
    digits = F.regexp_replace(name, r"^#[xX]?0*", "")
    hexadecimal = F.lower(name).startswith("#x")
    number = F.when(
        F.length(digits).between(1, 8),
        F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("bigint"),
    )
    by_number = F.coalesce(
        F.try_element_at(_pairs_literal(_windows_1252()), number.cast("string")),
        F.when(number.isNull(), F.lit("\ufffd")).otherwise(_code_point(number)),
    )
    by_name = F.coalesce(
        F.try_element_at(_pairs_literal(_named_references()), name), F.concat(F.lit("&"), name)
    )
    return (
        F.when(name == "", F.concat(F.lit("&"), piece))
        .when(name.startswith("#"), F.concat(by_number, rest))
        .otherwise(F.concat(by_name, rest))
    )


def _resolve_all(text: Column) -> Column:
    pieces = F.split(text, "&")
    return bind(
        pieces,
        lambda p: F.concat(
            F.get(p, F.lit(0)),
            F.array_join(F.transform(F.slice(p, 2, F.size(p)), _resolve), ""),
        ),
    )


def unescape(text: Column) -> Column:
    """Decode character references once, from left to right.

    The frequent ones are plain replacements, ``&amp;`` last so that nothing is decoded
    twice; only text with any other reference takes the general way.
    """
    plain = text
    for name in _FREQUENT[1:]:
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(html5[f"{name};"]))
    decoded = bind(
        plain,
        lambda t: F.when(F.regexp_like(t, F.lit("&(?!amp;)")), _resolve_all(t)).otherwise(
            F.replace(t, F.lit("&amp;"), F.lit("&"))
        ),
    )
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def strip_html(html: Column) -> Column:
    """Visible text: markup, comments, scripts and styles removed, text nodes trimmed
    and joined by one space."""
    nodes = F.split(bind(F.regexp_replace(html, _MARKUP, _CUT), unescape), _CUT)
    kept = F.filter(F.transform(nodes, strip), lambda node: F.length(node) > 0)
    return F.array_join(kept, " ")
