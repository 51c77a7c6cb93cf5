"""Name normalisation as native column expressions, each with the scalar function it is tested against."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that phonetic normalisation spells out (fixed values).
SPELT_OUT = {"ß": "ss", "æ": "ae", "ǽ": "ae", "ø": "o", "đ": "d"}


@lru_cache(1)
def fold_table() -> tuple[str, str]:
    """Characters with a canonical decomposition and their base letters; after them, combining marks, which go.

    Made from the Unicode database: every character of the basic plane (but Hangul) whose decomposition is one base and
    marks.
    """
    source, target, marks = [], [], []
    for code in range(0x80, 0x10000):
        c = chr(code)
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        if unicodedata.combining(c) or unicodedata.category(c) == "Mn":
            marks.append(c)
            continue
        base = [x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x) and unicodedata.category(x) != "Mn"]
        if len(base) == 1 and base[0] != c:
            source.append(c)
            target.append(base[0])
    return "".join(source + marks), "".join(target)


def fold(c: Column) -> Column:
    """c without diacritics."""
    return F.translate(c, *fold_table())


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_text(c: Column) -> Column:
    """Decomposed, without combining marks, lower case, without white space at the ends."""
    return _trim(F.lower(fold(c)))


def normalize_text_scalar(s: str | None) -> str | None:
    if s is None:
        return None
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c) and unicodedata.category(c) != "Mn").lower().strip()


def normalize_simple(c: Column) -> Column:
    """Trimmed, without full stops, hyphens as spaces, lower case; accents, apostrophes and runs of spaces stay."""
    return F.lower(F.translate(_trim(c), "-.", " "))


def normalize_simple_scalar(s: str) -> str:
    return s.strip().replace(".", "").replace("-", " ").lower()


def normalize_phonetic(c: Column) -> Column:
    """Folded, lower case, ASCII letters and single spaces only; some letters are spelt out."""
    c = F.lower(F.trim(c))
    for letter, spelt in SPELT_OUT.items():
        c = F.replace(c, F.lit(letter), F.lit(spelt))
    c = F.regexp_replace(fold(c), r"[^a-z\t\n\f\r ]", "")
    return F.rtrim(F.regexp_replace(c, r"[\t\n\f\r ]+", " "))


def normalize_phonetic_scalar(s: str) -> str:
    s = "".join(SPELT_OUT.get(c, c) for c in s.strip().lower())
    s = re.sub(r"[^a-z\t\n\f\r ]", "", unicodedata.normalize("NFD", s))
    return re.sub(r"[\t\n\f\r ]+", " ", s).rstrip()


def full_name(first: Column, last: Column, middle: Column | None = None) -> Column:
    """Parts with one space between; a missing middle name leaves two, and the ends are trimmed."""
    parts = [first, last] if middle is None else [first, middle, last]
    joined = F.coalesce(parts[0], F.lit(""))
    for p in parts[1:]:
        joined = F.concat(joined, F.lit(" "), F.coalesce(p, F.lit("")))
    return normalize_simple(joined)
