"""Phonetic codes: a four-character Soundex and initials as native expressions, Double Metaphone as an Arrow function."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Soundex digits of the letters a to z; 0 for letters without one (fixed values).
DIGITS = "01230120022455012623010202"


def soundex4(c: Column) -> Column:
    """Letter and three digits.  The first letter's digit doesn't suppress a following one, and any letter without a
    digit ends a run; characters that aren't ASCII letters are passed over; nothing left gives 0000."""
    letters = F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z]", "")
    tail = F.translate(F.lower(F.substring(letters, 2, 1 << 20)), "abcdefghijklmnopqrstuvwxyz", DIGITS)
    for digit in "123456":
        tail = F.regexp_replace(tail, f"{digit}+", digit)
    code = F.concat(F.upper(F.substring(letters, 1, 1)), F.replace(tail, F.lit("0"), F.lit("")))
    return F.when(letters == "", "0000").otherwise(F.rpad(F.substring(code, 1, 4), 4, "0"))


def soundex4_scalar(s: str) -> str:
    letters = [c for c in s if c.isascii() and c.isalpha()]
    if not letters:
        return "0000"
    out, last = letters[0].upper(), "0"
    for c in letters[1:]:
        digit = DIGITS[ord(c.lower()) - 97]
        if digit not in ("0", last):
            out += digit
        last = digit
    return (out + "000")[:4]


def coarse_soundex(code: Column) -> Column:
    """A Soundex with its last two digits as 0."""
    return F.concat(F.substring(code, 1, 2), F.lit("00"))


def ascii_initial(c: Column) -> Column:
    """The first ASCII letter in upper case, or ? if there is none; null stays null."""
    found = F.upper(F.regexp_extract(c, "[A-Za-z]", 0))
    return F.when(found == "", "?").otherwise(found)


def first_char_initial(c: Column) -> Column:
    """The first character, in upper case if it is an ASCII letter."""
    first = F.substring(c, 1, 1)
    return F.when(first.rlike("^[a-z]$"), F.upper(first)).otherwise(first)


class _Word:
    """A word under encoding: look-ups that never leave it."""

    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        self.slavic = any(x in text for x in ("W", "K", "CZ", "WITZ"))
        self.germanic = text.startswith(("VAN ", "VON ", "SCH"))

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < self.n else "\0"

    def has(self, i: int, *words: str) -> bool:
        """One of words stands at i."""
        return i >= 0 and any(self.text.startswith(w, i) for w in words)

    def vowel(self, i: int) -> bool:
        return self.at(i) in "AEIOUY"


def _c(w: _Word, i: int) -> tuple[str, int]:
    if w.has(i, "CHIA") or (
        i > 1 and not w.vowel(i - 2) and w.has(i - 1, "ACH") and (w.at(i + 2) not in "IE" or w.has(i - 2, "BACHER", "MACHER"))
    ):
        return "K", 2
    if i == 0 and w.has(0, "CAESAR"):
        return "S", 2
    if w.has(i, "CH"):
        return _ch(w, i), 2
    if w.has(i, "CZ") and not w.has(i - 2, "WICZ"):
        return "S", 2
    if w.has(i + 1, "CIA"):
        return "X", 3
    if w.has(i, "CC") and not (i == 1 and w.at(0) == "M"):
        if w.at(i + 2) in "IEH" and not w.has(i + 2, "HU"):
            hard = (i == 1 and w.at(0) == "A") or w.has(i - 1, "UCCEE", "UCCES")
            return ("KS" if hard else "X"), 3
        return "K", 2
    if w.has(i, "CK", "CG", "CQ"):
        return "K", 2
    if w.has(i, "CI", "CE", "CY"):
        return "S", 2
    if w.has(i + 1, " C", " Q", " G"):
        return "K", 3
    return "K", 2 if w.at(i + 1) in "CKQ" and not w.has(i + 1, "CE", "CI") else 1


def _ch(w: _Word, i: int) -> str:
    if i > 0 and w.has(i, "CHAE"):
        return "K"
    if i == 0 and w.has(1, "HARAC", "HARIS", "HOR", "HYM", "HIA", "HEM") and not w.has(0, "CHORE"):
        return "K"
    greek = w.germanic or w.has(i - 2, "ORCHES", "ARCHIT", "ORCHID") or w.at(i + 2) in "TS"
    if greek or ((i == 0 or w.at(i - 1) in "AOUE") and (w.at(i + 2) in "LRNMBHFVW " or i + 1 == w.n - 1)):
        return "K"
    return "K" if i > 0 and w.has(0, "MC") else "X"


def _d(w: _Word, i: int) -> tuple[str, int]:
    if w.has(i, "DG"):
        return ("J", 3) if w.at(i + 2) in "IEY" else ("TK", 2)
    return "T", 2 if w.at(i + 1) in "TD" else 1


def _g(w: _Word, i: int) -> tuple[str, int]:
    after = w.at(i + 1)
    if after == "H":
        return _gh(w, i), 2
    if after == "N":
        if i == 1 and w.vowel(0) and not w.slavic:
            return "KN", 2
        return ("KN" if w.has(i + 2, "EY") or w.slavic else "N"), 2
    if w.has(i + 1, "LI") and not w.slavic:
        return "KL", 2
    if i == 0 and (after == "Y" or w.has(1, "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER")):
        return "K", 2
    if (w.has(i + 1, "ER") or after == "Y") and not w.has(0, "DANGER", "RANGER", "MANGER") and not w.has(i - 1, "E", "I", "RGY", "OGY"):
        return "K", 2
    if after in "EIY" or w.has(i - 1, "AGGI", "OGGI"):
        return ("K" if w.germanic or w.has(i + 1, "ET") else "J"), 2
    return "K", 2 if after == "G" else 1


def _gh(w: _Word, i: int) -> str:
    if i > 0 and not w.vowel(i - 1):
        return "K"
    if i == 0:
        return "J" if w.at(2) == "I" else "K"
    if w.has(i - 2, "B", "H", "D") or w.has(i - 3, "B", "H", "D") or w.has(i - 4, "B", "H"):
        return ""
    if i > 2 and w.at(i - 1) == "U" and w.has(i - 3, "C", "G", "L", "R", "T"):
        return "F"
    return "K" if w.at(i - 1) != "I" else ""


def _h(w: _Word, i: int) -> tuple[str, int]:
    return ("H", 2) if (i == 0 or w.vowel(i - 1)) and w.vowel(i + 1) else ("", 1)


def _j(w: _Word, i: int) -> tuple[str, int]:
    if w.has(i, "JOSE") or w.has(0, "SAN "):
        spanish = (i == 0 and w.at(4) == " ") or w.n == 4 or w.has(0, "SAN ")
        return ("H" if spanish else "J"), 1
    hispanic = w.vowel(i - 1) and not w.slavic and w.at(i + 1) in "AO"
    heard = i == 0 or hispanic or i == w.n - 1 or (w.at(i + 1) not in "LTKSNMBZ" and not w.has(i - 1, "S", "K", "L"))
    return ("J" if heard else ""), 2 if w.at(i + 1) == "J" else 1


def _m(w: _Word, i: int) -> tuple[str, int]:
    silent = w.has(i - 1, "UMB") and (i + 1 == w.n - 1 or w.has(i + 2, "ER"))
    return "M", 2 if w.at(i + 1) == "M" or silent else 1


def _p(w: _Word, i: int) -> tuple[str, int]:
    if w.at(i + 1) == "H":
        return "F", 2
    return "P", 2 if w.at(i + 1) in "PB" else 1


def _r(w: _Word, i: int) -> tuple[str, int]:
    french = i == w.n - 1 and not w.slavic and w.has(i - 2, "IE") and not w.has(i - 4, "ME", "MA")
    return ("" if french else "R"), 2 if w.at(i + 1) == "R" else 1


def _s(w: _Word, i: int) -> tuple[str, int]:
    if w.has(i - 1, "ISL", "YSL"):
        return "", 1
    if i == 0 and w.has(0, "SUGAR"):
        return "X", 1
    if w.has(i, "SH"):
        return ("S" if w.has(i + 1, "HEIM", "HOEK", "HOLM", "HOLZ") else "X"), 2
    if w.has(i, "SIO", "SIA"):
        return "S", 3
    if (i == 0 and w.at(1) in "MNLW") or w.at(i + 1) == "Z":
        return "S", 2 if w.at(i + 1) == "Z" else 1
    if w.has(i, "SC"):
        if w.at(i + 2) == "H":
            if w.has(i + 3, "ER", "EN"):
                return "X", 3
            return ("SK" if w.has(i + 3, "OO", "UY", "ED", "EM") else "X"), 3
        return ("S" if w.at(i + 2) in "IEY" else "SK"), 3
    french = i == w.n - 1 and w.has(i - 2, "AI", "OI")
    return ("" if french else "S"), 2 if w.at(i + 1) in "SZ" else 1


def _t(w: _Word, i: int) -> tuple[str, int]:
    if w.has(i, "TION", "TIA", "TCH"):
        return "X", 3
    if w.has(i, "TH", "TTH"):
        return ("T" if w.has(i + 2, "OM", "AM") or w.germanic else "0"), 2
    return "T", 2 if w.at(i + 1) in "TD" else 1


def _w(w: _Word, i: int) -> tuple[str, int]:
    if w.has(i, "WR"):
        return "R", 2
    if i == 0 and (w.vowel(1) or w.has(0, "WH")):
        return "A", 1
    if (i == w.n - 1 and w.vowel(i - 1)) or w.has(i - 1, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or w.has(0, "SCH"):
        return "", 1
    return ("TS", 4) if w.has(i, "WICZ", "WITZ") else ("", 1)


def _x(w: _Word, i: int) -> tuple[str, int]:
    if i == 0:
        return "S", 1
    french = i == w.n - 1 and (w.has(i - 3, "IAU", "EAU") or w.has(i - 2, "AU", "OU"))
    return ("" if french else "KS"), 2 if w.at(i + 1) in "CX" else 1


def _z(w: _Word, i: int) -> tuple[str, int]:
    if w.at(i + 1) == "H":
        return "J", 2
    return "S", 2 if w.at(i + 1) == "Z" else 1


_RULES = {"C": _c, "D": _d, "G": _g, "H": _h, "J": _j, "M": _m, "P": _p, "R": _r, "S": _s, "T": _t, "W": _w, "X": _x, "Z": _z}
#: Letters that sound one way, a doubled one once.
_PLAIN = {"B": "P", "F": "F", "K": "K", "L": "L", "N": "N", "Q": "K", "V": "F"}


@lru_cache(1 << 16)
def double_metaphone(text: str, length: int = 4) -> str:
    """The primary Double Metaphone code of a text of ASCII letters and spaces (published algorithm of L. Philips)."""
    w = _Word(text.strip().upper())
    code, i = "", 1 if w.has(0, "GN", "KN", "PN", "WR", "PS") else 0
    while i < w.n and len(code) < length:
        c = w.at(i)
        if c in "AEIOUY":
            add, step = ("A" if i == 0 else ""), 1
        elif c in _PLAIN:
            add, step = _PLAIN[c], 2 if w.at(i + 1) == c else 1
        elif c in _RULES:
            add, step = _RULES[c](w, i)
        else:
            add, step = "", 1
        code, i = code + add, i + step
    return code[:length]


@F.arrow_udf(StringType())
def metaphone_code(names: pa.Array) -> pa.Array:
    """Codes of names that have gone through normalize_phonetic; each distinct name of a batch is encoded once."""
    coded = names.dictionary_encode()
    return pa.array([double_metaphone(x) for x in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
