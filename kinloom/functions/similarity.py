"""Similarities of names and birthdates."""

from __future__ import annotations

from datetime import date
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType


def levenshtein_pct(a: Column, b: Column) -> Column:
    """(1 - edit distance in characters / bytes of the longer) * 100; two empty strings are 100 alike."""
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(longest == 0, 100.0).otherwise((1 - F.levenshtein(a, b) / longest) * 100)


def within(a: Column, b: Column, distance: int = 2) -> Column:
    """The edit distance is at most distance (the native function stops counting beyond it)."""
    return F.levenshtein(a, b, distance).between(0, distance)


def levenshtein_scalar(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def levenshtein_pct_scalar(a: str, b: str) -> float:
    longest = max(len(a.encode()), len(b.encode()))
    return (1 - levenshtein_scalar(a, b) / longest) * 100 if longest else 100.0


def jaro(a: str, b: str, *, whole_transpositions: bool = True) -> float:
    """Jaro similarity; whole_transpositions rounds half the characters out of order down to a whole number."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, mine = [True] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == x:
                free[j] = False
                mine.append(x)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [y for y, f in zip(b, free, strict=True) if not f]
    half = sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2
    half = int(half) if whole_transpositions else half
    return (m / len(a) + m / len(b) + (m - half) / m) / 3


@lru_cache(1 << 17)
def jaro_winkler(a: str, b: str, *, gate: float = 0.7, whole_transpositions: bool = True) -> float:
    """Jaro with 0.1 of what is missing added for each of up to four common first characters, where Jaro is above gate.

    gate=-1 and whole_transpositions=False, on the first 64 bytes, is the variant that the device kernels have.
    """
    j = jaro(a, b, whole_transpositions=whole_transpositions)
    if j <= gate:
        return j
    common = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        common += 1
    return j + 0.1 * common * (1 - j)


#: Characters of a name that fit into a machine word, and the words whose lowest n bits are set.
WORD = 64
_LOWEST = np.array([(1 << n) - 1 for n in range(WORD + 1)], np.uint64)


class Names:
    """The different names of a batch on one side, as numbers of characters."""

    def __init__(self, texts: list[str]):
        self.texts, self.sizes = texts, np.fromiter(map(len, texts), np.int64, len(texts))
        self.width = min(max(int(self.sizes.max(initial=0)), 1), WORD)
        self.codes = np.array([t[:WORD] for t in texts], f"U{self.width}").view(np.uint32).reshape(len(texts), self.width)


def jaro_of(one: Names, two: Names, i: np.ndarray, j: np.ndarray, *, whole_transpositions: bool = True, gate: float | None = None) -> np.ndarray:
    """Jaro of one.texts[i] and two.texts[j] for arrays of numbers; with a gate Jaro-Winkler.

    A name of up to WORD characters is a word of bits for each character that occurs, and all pairs of a chunk take a step
    of the comparison together.  Pairs with a longer name are compared by jaro and jaro_winkler.
    """
    out, fits = np.zeros(len(i)), (one.sizes[i] <= WORD) & (two.sizes[j] <= WORD)
    plain = (lambda a, b: jaro(a, b, whole_transpositions=whole_transpositions)) if gate is None else (lambda a, b: jaro_winkler(a, b, gate=gate, whole_transpositions=whole_transpositions))
    out[~fits] = [plain(one.texts[x], two.texts[y]) for x, y in zip(i[~fits].tolist(), j[~fits].tolist(), strict=True)]
    present = np.zeros(max(int(n.codes.max(initial=0)) for n in (one, two)) + 1, bool)
    for n in (one, two):
        present[n.codes] = True
    number, letters = np.cumsum(present) - 1, int(present.sum())
    first, second = number[one.codes], number[two.codes]
    order = np.nonzero(fits)[0]
    order = order[np.argsort(-one.sizes[i[order]], kind="stable")]  # a step takes the first pairs, which are long enough
    step = int(min(max((1 << 21) // max(letters, 1), 64), 8192))  # a chunk's words of bits stay within 16 MB
    for at in range(0, len(order), step):
        some = order[at : at + step]
        out[some] = _jaro_words(first, one.sizes, second, two.sizes, i[some], j[some], letters, whole_transpositions, gate)
    return out


def _jaro_words(first, sizes, second, others, i, j, letters: int, whole: bool, gate: float | None) -> np.ndarray:
    one, bit = np.uint64(1), lambda n: np.uint64(1 << n)
    names, own = np.unique(j, return_inverse=True)
    has = np.zeros(len(names) * letters, np.uint64)  # by name and character: where it stands
    rows, long = np.arange(len(names)) * letters, others[names]
    for place in range(int(long.max(initial=0))):
        there = np.nonzero(long > place)[0]
        has[rows[there] + second[names[there], place]] |= bit(place)
    la, lb, a, base = sizes[i], others[j], np.ascontiguousarray(first[i].T), own * letters
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    free, taken, window = np.full(len(i), ~np.uint64(0)), np.zeros(len(i), np.uint64), _LOWEST[np.minimum(reach + 1, WORD)]
    for place, n in enumerate(np.searchsorted(-la, -np.arange(int(la.max(initial=0)))).tolist()):
        if place:
            window = (window << one) | (place <= reach).astype(np.uint64)
        found = has[base[:n] + a[place, :n]] & window[:n] & free[:n]
        free[:n] ^= found & (~found + one)  # the first of them
        taken[:n] |= (found != 0).astype(np.uint64) << np.uint64(place)
    m = np.bitwise_count(taken).astype(np.int64)
    mine, theirs, apart = taken, ~free, np.zeros(len(i), np.int64)
    (u, x_all), (v, y_all) = ((c.shape[1], c.ravel()) for c in (first, second))
    for _ in range(int(m.max(initial=0))):  # the n-th character taken on either side
        x, y = (np.minimum(np.bitwise_count(~w & (w - one)), n - 1) for w, n in ((mine, u), (theirs, v)))
        apart += (mine != 0) & (x_all[i * u + x] != y_all[j * v + y])
        mine, theirs = mine & (mine - one), theirs & (theirs - one)
    half = apart // 2 if whole else apart / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.where(m > 0, (m / la + m / lb + (m - half) / m) / 3, 0.0)
    value = np.where((la == 0) & (lb == 0), 1.0, value)
    if gate is None:
        return value
    head = min(4, u, v)
    same = (first[i, :head] == second[j, :head]) & (np.arange(head) < np.minimum(la, lb)[:, None])
    common = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    return np.where(value <= gate, value, value + 0.1 * common * (1 - value))


def _by_distinct_pairs(a: pa.Array, b: pa.Array, how: dict, part=lambda text: text) -> pa.Array:
    """jaro_of * 100 of each pair of a batch (of a part of the names); null where either is.  Each distinct pair is measured once."""
    x, y = (c.dictionary_encode() for c in (a, b))
    whole = np.logical_and(*(c.is_valid().to_numpy(zero_copy_only=False) for c in (a, b)))
    i, j = (c.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[whole] for c in (x, y))
    one, two = (Names([part(t) for t in c.dictionary.to_pylist()]) for c in (x, y))
    n = max(len(two.texts), 1)
    pairs, place = np.unique(i * n + j, return_inverse=True)
    out = np.zeros(len(a))
    if len(pairs):
        out[whole] = (jaro_of(one, two, pairs // n, pairs % n, **how) * 100)[place]
    return pa.array(out, mask=~whole)


def _first_bytes(text: str) -> str:
    return text.encode()[:64].decode("latin-1")  # a character for each byte


@F.arrow_udf(DoubleType())
def _jaro_winkler_pct(a: pa.Array, b: pa.Array) -> pa.Array:
    return _by_distinct_pairs(a, b, {"gate": 0.7})


@F.arrow_udf(DoubleType())
def _jaro_pct(a: pa.Array, b: pa.Array) -> pa.Array:
    return _by_distinct_pairs(a, b, {})


@F.arrow_udf(DoubleType())
def _device_jaro_winkler_pct(a: pa.Array, b: pa.Array) -> pa.Array:
    return _by_distinct_pairs(a, b, {"gate": -1.0, "whole_transpositions": False}, _first_bytes)


def jaro_winkler_pct(a: Column, b: Column) -> Column:
    """Jaro-Winkler * 100 by Arrow batches; each distinct pair of a batch is compared once.

    Declared non-deterministic so that a plan that uses it in a filter and a projection evaluates it once.
    """
    return _jaro_winkler_pct.asNondeterministic()(a, b)


def jaro_pct(a: Column, b: Column) -> Column:
    """Jaro * 100, as jaro_winkler_pct."""
    return _jaro_pct.asNondeterministic()(a, b)


def device_jaro_winkler_pct(a: Column, b: Column) -> Column:
    """The kernels' Jaro-Winkler * 100: over the first 64 bytes, half transpositions count, and every Jaro is raised."""
    return _device_jaro_winkler_pct.asNondeterministic()(a, b)


def birthdate_similarity_pct(a: Column, b: Column) -> Column:
    """100 equal; 90 a day apart; same year: 85 day and month swapped, 70 same month, 50 other; 40 years one apart; 0."""
    swapped = (F.month(a) == F.day(b)) & (F.day(a) == F.month(b))
    years = F.abs(F.year(a) - F.year(b))
    same_year = F.when(swapped, 85.0).when(F.month(a) == F.month(b), 70.0).otherwise(50.0)
    graded = F.when(a == b, 100.0).when(F.abs(F.datediff(a, b)) == 1, 90.0).when(years == 0, same_year).when(years == 1, 40.0).otherwise(0.0)
    return F.when(a.isNotNull() & b.isNotNull(), graded)


def birthdate_similarity_scalar(a: date, b: date) -> float:
    if a == b:
        return 100.0
    if abs((a - b).days) == 1:
        return 90.0
    if a.year == b.year:
        if (a.month, a.day) == (b.day, b.month):
            return 85.0
        return 70.0 if a.month == b.month else 50.0
    return 40.0 if abs(a.year - b.year) == 1 else 0.0


def composite_score(name_pct: Column, birthdate_pct: Column) -> Column:
    """Seven tenths of the name score and three of the birthdate's."""
    return 0.7 * name_pct + 0.3 * birthdate_pct


def rounded_percent(score: Column) -> Column:
    """A score as a whole percent from 0 to 100."""
    return F.least(F.greatest(F.round(score), F.lit(0)), F.lit(100)).cast("int")


def parse_threshold(text: str | None, *, least: float = 0.6, default: float = 0.95) -> float:
    """``95``, ``95%`` or ``0.95`` as a share between least and 1; anything else is default.  Households use least=0.5."""
    raw = (text or "").strip()
    try:
        value = float(raw.removesuffix("%").strip())
    except ValueError:
        return default
    if value != value:
        return default
    if raw.endswith("%") or value > 1:
        value /= 100
    return min(max(value, least), 1.0)


def fnv1a64(data: bytes) -> int:
    """FNV-1a with 64 bits (fixed offset and prime)."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


@F.arrow_udf(LongType())
def fnv1a64_hash(keys: pa.Array) -> pa.Array:
    """FNV-1a of strings in UTF-8, as a signed long; null stays null."""
    raw = [k or b"" for k in keys.cast(pa.binary()).to_pylist()]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    order = np.argsort(-sizes, kind="stable")  # the longest first: those that have a byte i are the first of all
    data, begins = np.frombuffer(b"".join(raw), np.uint8), (np.cumsum(sizes) - sizes)[order]
    h = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
    for i, n in enumerate(np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0)))).tolist()):
        h[:n] = (h[:n] ^ data[begins[:n] + i]) * np.uint64(0x100000001B3)
    out = np.empty(len(raw), np.int64)
    out[order] = h.view(np.int64)
    return pa.array(out, mask=keys.is_null().to_numpy(zero_copy_only=False))


def join_key(first: Column, last: Column, birthdate: Column, middle: Column | None = None) -> Column:
    """last, first[, middle], date with unit separators; null if a part other than the middle name is null."""
    parts = [last, first] + ([F.coalesce(middle, F.lit(""))] if middle is not None else []) + [birthdate.cast("string")]
    whole = parts[0]
    for p in parts[1:]:
        whole = F.concat(whole, F.lit("\x1f"), p)
    return whole
