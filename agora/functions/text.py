"""Text functions as column expressions.

Java's word and space classes are ASCII unless (?U) is set, and ``trim`` strips
spaces only, so both are spelled out where Unicode text is meant.
"""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from agora import config


#: White space as Unicode has it, but for the plain space: as a class, and as its characters.
SPACE = "\t-\r\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = "".join(map(chr, (*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f mentions it: as a lambda's variable it can't be inlined."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def where(c: Column, test: Callable[[Column], Column], f: Callable[[Column], Column]) -> Column:
    """f of the value where the (cheap) test holds, else the value."""
    return let(c, lambda x: F.when(test(x), f(x)).otherwise(x))


def replaced(c: Column, pattern: str, by: str, *signs: str) -> Column:
    """regexp_replace for texts that contain one of the signs, without which the pattern can't match."""

    def test(x):
        found = F.contains(x, F.lit(signs[0]))
        for sign in signs[1:]:
            found = found | F.contains(x, F.lit(sign))
        return found

    return where(c, test, lambda x: F.regexp_replace(x, pattern, by))


def not_ascii(c: Column) -> Column:
    return F.length(c) != F.octet_length(c)


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, f"^[{SPACE} ]+|[{SPACE} ]+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    even = where(c, lambda x: not_ascii(x) | x.rlike("[\t-\r]"), lambda x: F.translate(x, SPACES, " " * len(SPACES)))
    return F.trim(where(even, lambda x: F.contains(x, F.lit("  ")), lambda x: F.regexp_replace(x, " {2,}", " ")))


def token_count(c: Column) -> Column:
    """Tokens between white space; 0 for null or blank text."""
    spaces = lambda t: F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    return let(collapse(F.coalesce(c, F.lit(""))), lambda t: F.when(t == "", 0).otherwise(spaces(t) + 1)).cast("int")


def repair_mojibake(c: Column) -> Column:
    """UTF-8 that was read as Latin-1: where a tell-tale letter occurs, the text's Latin-1 bytes are read as
    UTF-8, without what is in neither. This also drops accented letters of sound text with such a letter."""
    latin = lambda x: F.encode(F.regexp_replace(x, "[^\\x00-\\xFF]", ""), "ISO-8859-1")
    sound = lambda x: F.replace(F.make_valid_utf8(latin(x).cast("string")), F.lit("\ufffd"), F.lit(""))
    return where(c, lambda x: x.rlike("[\u00e2\u00c3\u00c2]"), lambda x: F.coalesce(F.nullif(sound(x), F.lit("")), x))


def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    """HTML entities as characters; only texts with an ampersand leave the JVM."""
    return F.coalesce(F.pandas_udf(_unescape, "string")(F.when(F.contains(c, F.lit("&")), c)), c)


def plain_punctuation(c: Column) -> Column:
    """Typographic quotes, dashes, ellipsis and hard spaces as ASCII."""
    plain = lambda x: F.replace(F.translate(x, "\u2018\u2019\u201c\u201d\u2013\u2014\u00a0", "''\"\"-- "), F.lit("\u2026"), F.lit("..."))
    return where(c, not_ascii, plain)


# What each step of cleaning removes and puts in its place, and signs without which it can't occur.
MARKUP = (
    (r"\[([^\]]+)\]\(([^)]+)\)", "$1", "]("),
    (r"(?i)https?://\S+|www\.\S+", " ", "://", "w.", "W."),
    (r"(?U)\bu/[A-Za-z0-9_-]+\b", " ", "u/"),
    (r"(?U)\br/[A-Za-z0-9_-]+\b", " ", "r/"),
    (r"&(?:amp|lt|gt);", " ", "&"),
)
BACKTICK, CODE, QUOTED = (r"(?U)(?<=\w)`(?=\w)", "'", "`"), ("(?s)```.*?```", " ", "```"), (r"(?mdU)(^|\n)>\s+.*", " ", ">")
ZERO_WIDTH = ("[\u200b\u200c\u200d\ufeff]", " ")


def strip_markup(c: Column) -> Column:
    """Link targets, addresses, user and group handles, left-over entities and emphasis signs."""
    for step in MARKUP:
        c = replaced(c, *step)
    return collapse(where(c, lambda x: x.rlike("[*_`]"), lambda x: F.translate(x, "*_`", "   ")))


def straight(c: Column, mojibake: bool = True, entities: bool = True) -> Column:
    """The first steps of cleaning: encoding, entities, quotes and invisible characters."""
    t = repair_mojibake(c) if mojibake else c
    t = unescape(t) if entities else t
    t = F.replace(F.replace(t, F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"'))
    t = replaced(plain_punctuation(t), *BACKTICK)
    return where(t, not_ascii, lambda x: F.regexp_replace(x, *ZERO_WIDTH))


def clean(c: Column, mojibake: bool = True, entities: bool = True) -> Column:
    """The whole cleaning chain, in order; null is empty."""
    t = straight(F.coalesce(c, F.lit("")), mojibake, entities)
    return strip_markup(replaced(replaced(t, *CODE), *QUOTED))


def in_list(c: Column, values) -> Column:
    return c.isin(*values)


def is_marker(c: Column, markers=config.BODY_MARKERS) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(*markers), F.lit(False))


def normalized(c: Column) -> Column:
    return F.lower(collapse(c))


def contains_any(c: Column, phrases) -> Column:
    """Whether any phrase occurs, as a literal array and a lambda: one small expression for any number of them."""
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(c, p))


def matched(c: Column, phrases) -> Column:
    """The phrases that occur, in the order given."""
    return F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(c, p))


def truncate(c: Column, n: int, mark: str = "") -> Column:
    cut = F.substring(c, 1, n)
    return F.when(F.length(c) > n, F.concat(cut, F.lit(mark))).otherwise(cut)


def title_case(c: Column) -> Column:
    """A letter after any non-letter in upper case, others in lower case (``initcap`` starts words at spaces only)."""
    runs = F.regexp_extract_all(c, F.lit(r"(?U)\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1_000_000)))), "")


def sha1_of(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *parts))
