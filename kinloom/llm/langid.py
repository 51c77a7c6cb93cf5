"""Language identification by rank-order profiles.

A text's most frequent letter n-grams, ranked, are held against each language's profile: every n-gram costs the
difference of its two ranks, and one that the profile lacks costs the profile's length (out-of-place distance).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.base import arrow_schema, held_out, map_arrow

LONGEST = 3  # letters in an n-gram; three code points of 21 bits fill a 64-bit number
PROFILE = 300
GAP = np.uint64(1)  # what stands for characters that aren't letters


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point of the basic plane: its number if it is a letter, else 0 (a gap)."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x10000)], dtype=np.uint64)


def ngram_counts(text: str | None, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the lower-cased letters of a whole text as sorted numbers, and how often each occurs.

    Every run of other characters counts as one gap, which ends and begins words and is part of longer n-grams.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    known = _letters()[np.minimum(points, 0xFFFF)]
    if len(points) and points.max() > 0xFFFF:
        for c in np.unique(points[points > 0xFFFF]).tolist():
            known[points == c] = c if chr(c).isalpha() else 0
    if not known.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    framed = np.concatenate((np.zeros(1, np.uint64), known, np.zeros(1, np.uint64)))
    chars = framed[np.r_[True, (framed[1:] != 0) | (framed[:-1] != 0)]]  # the first character of a gap stands for it
    chars[chars == 0] = GAP  # not 0, so that n-grams of different lengths are different numbers
    found, counts, grams = [], [], np.zeros(len(chars), np.uint64)
    for n in range(1, longest + 1):
        if len(chars) < n:
            break
        grams = chars if n == 1 else (grams[:-1] << np.uint64(21)) | chars[n - 1 :]
        ordered = np.sort(grams)
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        value, count = ordered[starts], np.diff(np.r_[starts, len(ordered)])
        if n == 1:  # a gap by itself says nothing
            value, count = value[value != GAP], count[value != GAP]
        found.append(value)
        counts.append(count)
    return np.concatenate(found), np.concatenate(counts)


def _ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The size most frequent n-grams, the most frequent first; the smaller number first among equals."""
    return grams[np.lexsort((grams, -counts))[:size]]


class Profiles:
    """Each language's ranked n-grams, ready to be held against texts."""

    def __init__(self, ranked: dict[str, np.ndarray], size: int = PROFILE):
        self.names, self.size = sorted(ranked), size
        every = np.unique(np.concatenate([ranked[n] for n in self.names])) if self.names else np.zeros(0, np.uint64)
        self.grams = every
        self.ranks = np.full((len(self.names), len(every) + 1), size, dtype=np.int64)
        self.known = np.zeros((len(self.names), len(every) + 1), dtype=bool)
        for i, n in enumerate(self.names):
            at = np.searchsorted(every, ranked[n])
            self.ranks[i, at] = np.arange(len(at))
            self.known[i, at] = True

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (the first by name among equals) and 1 - its distance over the largest distance possible; ``und`` and 0 without letters or languages."""
        grams, counts = ngram_counts(text)
        if not len(grams) or not self.names:
            return "und", 0.0
        top = _ranked(grams, counts, self.size)
        at = np.searchsorted(self.grams, top)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == top, at, len(self.grams))
        own = np.arange(len(top))
        cost = np.where(self.known[:, at], np.abs(self.ranks[:, at] - own), self.size).sum(axis=1)
        best = int(cost.argmin())
        return self.names[best], float(1 - cost[best] / (self.size * len(top)))


def _drawn(rows: DataFrame, per_language: int) -> DataFrame:
    """text and lang of about per_language rows (text, lang, id) of each language, each different row once."""
    # A row for each language.
    share = {r["lang"]: per_language / r["count"] for r in rows.groupBy("lang").count().collect()}
    if not share:
        return rows.select("text", "lang")
    least = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    draw = F.shiftrightunsigned(F.xxhash64("id", "text"), 11) / F.lit(float(1 << 53))
    return rows.filter(draw < least[F.col("lang")]).dropDuplicates().select("text", "lang")


def fit_profiles(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 2000, size: int = PROFILE) -> Profiles:
    """Profiles from about per_language texts of each language, those with the smallest hashes of id and text.

    per_language bounds what is learnt from (a mean, not a hard limit); a language with fewer texts gives all of them, and
    rows that are equal teach once.  Languages have to be few: their profiles are held by the driver and every task.
    Rows whose language or text is null teach nothing.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("id")).filter("lang is not null and text is not null")
    drawn = _drawn(rows, per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[int, int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = sums.setdefault(lang, {})
                for g, c in zip(*(x.tolist() for x in ngram_counts(text)), strict=True):
                    own[g] = own.get(g, 0) + c
        for lang, own in sums.items():
            grams = np.fromiter(own, np.uint64, len(own)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(grams), pa.array(list(own.values()), type=pa.int64())], schema=arrow_schema("lang string,gram long,n long"))

    counted = drawn.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Each language's best of eight parts first, so that no task ranks a whole language.
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(8))).orderBy(F.desc("n"), "gram")
    best = counted.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= size).drop("r")
    found: dict[str, list[tuple[int, int]]] = {}
    for r in best.collect():  # at most eight profiles for each language
        found.setdefault(r["lang"], []).append((r["gram"], r["n"]))
    ranked = {}
    for lang, pairs in found.items():
        grams, counts = np.array([p[0] for p in pairs], np.int64).view(np.uint64), np.array([p[1] for p in pairs])
        ranked[lang] = _ranked(grams, counts, size)
    return Profiles(ranked, size)


def predict_languages(docs: DataFrame, profiles: Profiles, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, one row per input row; whole texts are read.

    A null text, an empty one and one without a letter are ``und`` with score 0, as is every text if no language was
    learnt.  Equal texts get equal rows.  Null and repeated ids are kept as they are.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        got = [profiles.predict(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    return map_arrow(rows, run, "doc_id long,lang_pred string,score double")


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Learn from the rows whose crc32 of the id modulo 3 is not 1, predict all rows, and say which were held out."""
    profiles = fit_profiles(docs.filter(~held_out(id_col, 3, 1)), text_col=text_col, lang_col=lang_col, id_col=id_col, **options)
    return predict_languages(docs, profiles, id_col=id_col, text_col=text_col).withColumn("held_out", held_out("doc_id", 3, 1)).select("doc_id", "held_out", "lang_pred", "score")
