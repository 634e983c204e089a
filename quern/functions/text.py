"""Scalar text functions as native column expressions.

Java's ``\\s`` and ``trim`` know ASCII blanks only, so the class ``WS`` spells out the Unicode white space that a word
count or a strip has to see.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.constants import STOP_WORDS

WS = r"\t-\r\x1c-\x1f\x85\p{Z}"
#: A line's end, as a text editor of Unicode text sees it.
EOL = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
LINK = r"\[{2}([^\]]+)\]{2}"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+\z", "")


def newlines(c: Column) -> Column:
    """Text with universal newlines translated."""
    return F.regexp_replace(c, "\r\n?", "\n")


def word_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(f"[^{WS}]+"), F.lit(0)))


def tokens(c: Column) -> Column:
    """Lower-cased whole words of two or more ASCII letters, but for stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"(?<![\p{L}\p{N}_])[a-z]{2,}+(?![\p{L}\p{N}_])"), F.lit(0))
    return F.filter(found, lambda x: ~x.isin(STOP_WORDS))


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def wikilinks(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(LINK), F.lit(1))


def slug(c: Column) -> Column:
    c = F.regexp_replace(strip(F.lower(c)), rf"[^\p{{L}}\p{{N}}_{WS}-]", "")
    return F.btrim(F.regexp_replace(c, f"[{WS}_]+", "-"), F.lit("-"))


def lines(c: Column) -> Column:
    """The text's lines; an end of line at the very end starts no further line."""
    return F.split(F.regexp_replace(c, rf"(?:{EOL})\z", ""), EOL)


def unquote(c: Column) -> Column:
    """Double quotes, then single ones, off both ends."""
    return F.btrim(F.btrim(c, F.lit('"')), F.lit("'"))


def link_of(path: Column) -> Column:
    """A path as a link names it: without any ".md", with forward slashes."""
    return F.replace(F.replace(path, F.lit(".md"), F.lit("")), F.lit("\\"), F.lit("/"))


def key_points(c: Column, most: int = 5) -> Column:
    return F.array_join(F.slice(F.filter(F.transform(lines(c), strip), lambda x: x.startswith("- ")), 1, most), "\n")
