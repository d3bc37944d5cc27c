"""Text expressions that follow Python's rules for white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python treats as white space, and the token pattern.
# Both are written with explicit classes, so Java and RE2 read them alike.
WHITESPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
WORD = rf"[^{WHITESPACE}]+"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
SENTENCE_END = r"([.!?])\s+"

_WHITESPACE_CHARACTERS = "".join(chr(n) for n in range(0x3001) if chr(n).isspace())


def word_count(text: Column) -> Column:
    """Number of white-space separated words; 0 for empty text."""
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of every kind, not just U+0020."""
    return F.trim(text, F.lit(_WHITESPACE_CHARACTERS))


def one_line(text: Column) -> Column:
    """Delete newlines; neighbouring words are joined, as no space is put in."""
    return F.replace(text, F.lit("\n"), F.lit(""))


def sentence_lines(text: Column) -> Column:
    """One sentence per line, by the rule "end mark, then white space"."""
    return F.regexp_replace(strip(text), SENTENCE_END, "$1\n")


def has_text(text: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(F.length(text) > 0, F.lit(False))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, and every other visible character on its own."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def text_digest(text: Column) -> Column:
    """A 256-bit content address, so that joins on long texts move 64 characters."""
    return F.sha2(text, 256)


def run_tag(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("-"))
